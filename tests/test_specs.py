"""Specifications, structures, prompts and serialization."""

from dataclasses import replace
from typing import Literal, Optional, TypedDict, Union

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from lexiloom.functions import structure as Y
from lexiloom.operators import engine
from lexiloom.plans import prompts
from lexiloom.plans import specs as S
from lexiloom.sources import serde
from pyspark.sql import types as P


class Inner:
    city: str
    zip: Optional[int]  # noqa: UP045


class Person:
    name: str
    homes: list[Inner]
    tags: dict[str, int]
    kind: Literal["a", 1]


@pytest.mark.parametrize("make", [
    lambda: S.Aspect("", "d"), lambda: S.Aspect("a", "d", llm_role="extractor_vision"), lambda: S.Aspect("a", "d", aspects=(S.Aspect("A", "x"),)),
    lambda: S.Aspect("a", "d", aspects=(S.Aspect("b", "e", aspects=(S.Aspect("c", "f"),)),)), lambda: S.Pipeline((S.Aspect("a", "d"), S.Aspect("A", "e"))),
    lambda: S.RatingConcept("r", "d", (3, 3)), lambda: S.RatingConcept("r", "d", (-1, 3)), lambda: S.LabelConcept("l", "d", ["x"]), lambda: S.LabelConcept("l", "d", ["x", "X"]),
    lambda: S.StringConcept("s", "d", llm_role="extractor_vision", add_references=True), lambda: S.JsonObjectConcept("j", "d", {}), lambda: S.JsonObjectConcept("j", "d", {"a": int}, examples=({"a": "x"},)),
    lambda: S.Model("nameless"), lambda: S.Model("a/b", pricing=S.Pricing(1, 2), auto_pricing=True), lambda: S.Model("ollama/x", auto_pricing=True), lambda: S.Pricing(-1, 0),
    lambda: S.Model("a/b", fallback=S.Model("a/c")), lambda: S.Model("a/b", fallback=S.Model("a/b", is_fallback=True)), lambda: S.Group((S.Model("a/b"),)), lambda: S.Group((S.Model("a/b"), S.Model("a/c"))),
])
def test_rules_of_specs(make):
    with pytest.raises((S.SpecError, Y.StructureError)):
        make()


def test_management_and_roles():
    p = S.Pipeline().add_aspects(S.Aspect("A", "a", concepts=(S.StringConcept("c", "x", llm_role="reasoner_text"),))).add_concepts(S.BooleanConcept("B", "b"))
    assert p.get_aspect("A").get_concept("c").value_type == "str" and len(p.get_concepts(["B"])) == 1
    with pytest.raises(S.SpecError):
        p.get_aspect("nope")
    assert p.roles == {"extractor_text", "reasoner_text"} and S.missing_roles(p, [S.Model("a/b")]) == {"reasoner_text"}
    assert not p.without_aspects().aspects and p.without_aspects("x").aspects and not p.without_concepts("B").concepts
    assert not p.needs_sentences and p.add_aspects(S.Aspect("D", "d", reference_depth="sentences")).needs_sentences
    g = S.Group((S.Model("a/b"), S.Model("a/c", role="reasoner_text"))).with_language("adapt")
    assert g.by_role("reasoner_text").output_language == "adapt" and g.roles == ["extractor_text", "reasoner_text"]
    with pytest.raises(S.SpecError):
        p.assign(p)
    assert p.assign(p, overwrite=True) is p
    assert "temperature" in S.Model("a/b").request() and "max_completion_tokens" in S.Model("a/b", reasoning=True).request()


TYPES = st.recursive(
    st.sampled_from([str, int, float, bool]) | st.lists(st.sampled_from(['a"b', "c\\d", "e", 1, 2, True, None]), min_size=1, max_size=3, unique_by=repr).map(lambda v: Literal[tuple(v)]),
    lambda t: t.map(lambda x: list[x]) | t.map(lambda x: dict[str, x]) | t.map(lambda x: Optional[x]) | st.tuples(t, t).map(lambda x: Union[x]),
    max_leaves=5,
)


@settings(max_examples=400, deadline=None)
@given(TYPES)
@example(list[Literal["e", "c\\d", True]])
@example(Optional[Literal["c\\d", "e", True]])  # noqa: UP045
@example(Optional[Literal["e", "c\\d", True]])  # noqa: UP045
@example(dict[str, Literal[1, True, "1"]])
def test_type_text_round_trip(t):
    text = Y.type_text(t)
    assert Y.type_text(Y.type_of(text)) == text


def test_structures():
    d = Y.to_dict(Person)
    assert Y.type_text(d) == '{name: str, homes: list_instance[{city: str, zip: optional[int]}], tags: dict[str, int], kind: literal["a", 1]}'
    assert Y.type_of("int | str | None") == Y.normalize(Optional[Union[int, str]])
    check = Y.compile_structure(Person)
    good = {"name": "x", "homes": [{"city": "y"}], "tags": {"k": 1}, "kind": "a"}
    assert check(good) is None
    for bad in ({**good, "name": 1}, {**good, "more": 1}, {**good, "homes": [{}]}, {**good, "tags": {"k": 1.5}}, {**good, "kind": True}, {k: v for k, v in good.items() if k != "name"}, []):
        assert check(bad)
    t = Y.spark_struct(Person)
    assert t["homes"].dataType == P.ArrayType(P.StructType([P.StructField("city", P.StringType()), P.StructField("zip", P.LongType())])) and t["kind"].dataType == P.VariantType()
    for wrong in ({"_a": int}, {"a": list}, {"a": set[int]}, {"a": {}}, {"a": [int, str]}, {"a": dict[int, str]}):
        with pytest.raises(Y.StructureError):
            Y.to_dict(wrong)


def test_tool_schema():
    class Where(TypedDict, total=False):
        city: str

    def find(q: str, n: int = 3, where: Where | None = None, kind: Literal["x", "y"] = "x") -> str:
        """Find things.

        :param q: what to find
        :param n: how many
        """
        return q

    s = Y.tool_schema(find)["function"]
    assert s["description"] == "Find things." and s["parameters"]["required"] == ["q"]
    assert s["parameters"]["properties"]["n"] == {"type": "integer", "description": "how many"}
    assert Y.schema_error({"q": "a", "where": {"city": "b"}, "kind": "y"}, s["parameters"]) is None
    for bad in ({}, {"q": 1}, {"q": "a", "x": 1}, {"q": "a", "kind": "z"}, {"q": "a", "n": True}):
        assert Y.schema_error(bad, s["parameters"])
    with pytest.raises(TypeError):
        Y.tool_schema(lambda x: x)


def test_prompts():
    specs = [S.StringConcept("Name", "who", examples=("A",)), S.LabelConcept("Kind", "what", ["x", "y"]), S.RatingConcept("R", "how", (1, 3)), S.JsonObjectConcept("J", "obj", {"a": int})]
    params = {p: getattr(specs[0], p) for p in engine.PARAMS}
    text = prompts.render("concept", specs, params, ["one", "​", "two"], [[], [], []], True)
    assert "C1: Kind" in text and "P0: one" in text and "P2: two" in text and "P1" not in text and '["x", "y"]' in text
    assert prompts.lint(prompts.render("concept", specs[:3], params, ["a"], [[]], False)) == []
    assert "one\n\ntwo" in prompts.render("concept", specs, params, ["one", "two"], [[], []], False)
    assert prompts.lint("([)]") and prompts.lint("<a><b></a></b>") and prompts.lint("a\n\n\n\nb") and not prompts.lint("<a>(x)</a>")
    assert prompts.has_tags("{{ x }}") and prompts.fill("a {{ x }}", {"x": 1}) == "a 1"
    with pytest.raises(ValueError):
        prompts.fill("nothing", {})
    parts = prompts.user_message("p", [("image/png", "QQ==")])["content"]
    assert parts[1]["image_url"]["url"] == "data:image/png;base64,QQ=="


def test_serialization_round_trip(tmp_path):
    p = S.Pipeline((S.Aspect("A", "a", concepts=(S.JsonObjectConcept("J", "j", Person), S.DateConcept("D", "d"))),), (S.LabelConcept("L", "l", ["ä", "b"], "multi_label", rule={"labels": {"ä": "x"}}),))
    text = serde.to_json(p)
    assert "ä" in text and serde.to_json(serde.from_json(text, "Pipeline")) == text
    m = S.Model("a/b", pricing=S.Pricing("0.40", 2), fallback=S.Model("a/c", is_fallback=True))
    assert serde.from_json(serde.to_json(m)) == m
    path = str(tmp_path / "m.json")
    serde.to_disk(m, path)
    assert serde.from_disk(path, "Model") == m
    with pytest.raises(S.SpecError):
        serde.from_disk(path, "Pipeline")
    with pytest.raises(ValueError):
        serde.to_disk(m, str(tmp_path / "m.txt"))
    assert replace(m, temperature=0.1) != m
