"""Calls, replies and results of single documents; call counts; retries; ledger; chat; sources; streams."""

import datetime as dt
import io
import json
import zipfile
from decimal import Decimal

import pytest
from conftest import SMALL
from lexiloom.functions import envelope
from lexiloom.operators import backends, chat, engine, extract, ledger, quality, score, segment
from lexiloom.plans import specs as S
from lexiloom.sources import docx, html, images
from lexiloom.streaming import streams

PARAMS = {"add_justifications": False, "justification_depth": "brief", "justification_max_sents": 2, "add_references": False, "reference_depth": "paragraphs"}
PARAS, SENTS = ["one. two.", "three"], [["one.", "two."], ["three"]]
BOOL, LABEL = S.BooleanConcept("B", "b"), S.LabelConcept("L", "l", ["x", "y"])


def concept(items, **params):
    spec = params.pop("spec", S.StringConcept("S", "s"))
    return envelope.concept_items([{"concept_id": "C0", "extracted_items": items}], [spec], PARAS, SENTS, PARAMS | params)[0]


def test_good_envelopes():
    asp = S.Aspect("A", "a")
    read = lambda reply, **p: envelope.aspect_items(reply, [asp], PARAS, SENTS, PARAMS | p)[0]
    assert [i["value"] for i in read([{"aspect_id": "A0", "paragraph_ids": ["P1", "P0"]}])] == ["one. two.", "three"]
    assert read([{"aspect_id": "A0", "paragraphs": [{"paragraph_id": "P1", "justification": "j"}]}], add_justifications=True)[0]["justification"] == "j"
    deep = [{"aspect_id": "A0", "paragraphs": [{"paragraph_id": "P0", "sentences": [{"sentence_id": "P0-S1"}]}]}]
    assert read(deep, reference_depth="sentences")[0] == {"value": "two.", "justification": None, "paras": [0], "sents": [(0, 1)]}
    assert concept([" x "])[0]["value"] == "x"
    assert concept([{"value": "x", "reference_paragraph_ids": ["P1", "P0"]}], add_references=True)[0]["paras"] == [0, 1]
    refs = [{"value": "x", "justification": "j", "reference_paragraphs": [{"reference_paragraph_id": "P0", "reference_sentence_ids": ["P0-S1"]}]}]
    assert concept(refs, add_references=True, add_justifications=True, reference_depth="sentences")[0]["sents"] == [(0, 1)]
    values = [(S.DateConcept("D", "d"), "1-2-2024", dt.date(2024, 2, 1)), (S.NumericalConcept("N", "n"), 1.5, 1.5), (S.NumericalConcept("N", "n", numeric_type="float"), 1, 1.0), (S.RatingConcept("R", "r", (0, 2)), 2, 2), (BOOL, False, False), (LABEL, {"labels": ["y"]}, ["y"]), (S.JsonObjectConcept("J", "j", {"a": int}), {"a": 1}, {"a": 1})]
    for spec, raw, want in values:
        assert concept([raw], spec=spec)[0]["value"] == want


@pytest.mark.parametrize(("spec", "raw"), [
    (S.StringConcept("S", "s"), "  "), (S.StringConcept("S", "s"), 1), (BOOL, "true"), (BOOL, 1), (S.NumericalConcept("N", "n", numeric_type="int"), 1.0), (S.NumericalConcept("N", "n"), True), (S.NumericalConcept("N", "n"), "1"),
    (S.RatingConcept("R", "r", (1, 3)), 4), (S.RatingConcept("R", "r", (1, 3)), "2"), (S.RatingConcept("R", "r", (1, 3)), 2.0), (S.DateConcept("D", "d"), "2024-02-01"), (S.DateConcept("D", "d"), "31-2-2024"), (S.DateConcept("D", "d"), None),
    (LABEL, {"labels": []}), (LABEL, {"labels": ["X"]}), (LABEL, {"labels": ["x", "y"]}), (LABEL, ["x"]), (LABEL, {"labels": ["x"], "more": 1}), (S.JsonObjectConcept("J", "j", {"a": int}), {"a": "1"}), (S.JsonObjectConcept("J", "j", {"a": int}), {"a": 1, "b": 2}), (S.JsonObjectConcept("J", "j", {"a": int}), []),
])
def test_bad_values(spec, raw):
    with pytest.raises(envelope.Invalid):
        concept([raw], spec=spec)


@pytest.mark.parametrize("reply", [
    {"aspect_id": "A0"}, [1], [{"aspect_id": "A1", "paragraph_ids": []}], [{"aspect_id": "X0", "paragraph_ids": []}], [{"aspect_id": "A0", "paragraph_ids": ["P9"]}], [{"aspect_id": "A0", "paragraph_ids": "P0"}],
    [{"aspect_id": "A0", "paragraph_ids": [], "more": 1}], [{"aspect_id": "A0", "paragraphs": []}], [{"aspect_id": 0, "paragraph_ids": []}],
])
def test_bad_envelopes(reply):
    with pytest.raises(envelope.Invalid):
        envelope.aspect_items(reply, [S.Aspect("A", "a")], PARAS, SENTS, PARAMS)


def document(n=7):
    paras = [f"para {i} x{i}" if i != 3 else "​​x3" for i in range(n)]
    return engine.Document(1, "\n".join(paras), paras, [[p] for p in paras])


def run_of(settings, models=None, backend=None, doc=None):
    models = models or [S.Model("r/x")]
    return engine.Run(doc or document(), {m.role: m for m in models}, {m.role: (backend or backends.RuleBackend(), None) for m in models}, settings)


def test_call_counts():
    specs = [S.StringConcept(f"c{i}", f"d{i}", rule=f"x{i}", add_references=i % 2 == 0) for i in range(4)]
    for settings, want in ((engine.Settings(), 2), (engine.Settings(paragraphs_per_call=3), 6), (engine.Settings(items_per_call=1), 4), (engine.Settings(concurrent=True), 4), (engine.Settings(concurrent=True, items_per_call=2), 2), (engine.Settings(paragraphs_per_call=500), 2)):
        run = run_of(settings)
        run.extract("concept", specs)
        assert len(run.calls) == want
    run = run_of(engine.Settings(paragraphs_per_call=3))
    found = run.extract("concept", [S.StringConcept("one", "d", rule=r"x\d", singular=True)])["one"]
    assert len(run.calls) == 1 and len(found.items) == 3  # the first chunk's items, all of them
    run = run_of(engine.Settings(), [S.Model("r/x", role="reasoner_text")])
    assert not run.extract("concept", specs)["c0"].processed and not run.calls


def test_references_are_absolute_over_chunks():
    found = run_of(engine.Settings(paragraphs_per_call=3)).extract("aspect", [S.Aspect("a", "d", rule="x[46]")])["a"]
    assert [i["paras"] for i in found.items] == [[4], [6]]


def test_levels_and_missing_specs():
    p = S.Pipeline((S.Aspect("A", "a", rule="x[125]", aspects=(S.Aspect("B", "b", rule="x[25]", concepts=(S.StringConcept("C", "c", rule=r"x\d", add_references=True),)),)), S.Aspect("none", "n", rule="zzz", concepts=(S.BooleanConcept("D", "d", rule="x"),))), (S.BooleanConcept("E", "e", rule="x6"),))
    found = {o: f for o, _, f in run_of(engine.Settings()).all(p)}
    assert [i["paras"] for i in found["aspect:A/aspect:B/concept:C"].items] == [[2], [5]]
    assert found["aspect:none"].processed and "aspect:none/concept:D" not in found and found["concept:E"].items[0]["value"] is True
    silent = backends.ReplayBackend({}, ["[]"])
    assert not run_of(engine.Settings(), backend=silent).extract("aspect", p.aspects)["A"].processed


def test_retries_fallback_and_whole_chunks():
    spec = S.NumericalConcept("n", "d", numeric_type="int", rule=r"\d")
    good = json.dumps([{"concept_id": "C0", "extracted_items": [1]}])
    model = S.Model("r/x", retries_invalid=1, fallback=S.Model("r/y", is_fallback=True, retries_invalid=0))
    for replies, calls, ok in ((["bad", good], 2, True), (["bad", "42", good], 3, True), (['[{"concept_id": "C0", "extracted_items": ["x"]}]'], 3, False)):
        run = engine.Run(document(), {"extractor_text": model}, {"extractor_text": (backends.ReplayBackend({}, replies), None)}, engine.Settings(raise_errors=False))
        found = run.extract("concept", [spec])["n"]
        assert (len(run.calls), found.processed, bool(run.errors)) == (calls, ok, not ok)
    assert run.calls[-1]["is_fallback"] and run.calls[0]["error"]
    with pytest.raises(engine.ExtractionFailed):
        run_of(engine.Settings(), backend=backends.ReplayBackend({}, ["bad"])).extract("concept", [spec])

    class SecondChunkBad:
        def complete(self, prompt, payload):
            return good if payload["text_chunk"] == 0 else "bad"

    run = run_of(engine.Settings(paragraphs_per_call=4, raise_errors=False), [S.Model("r/x", retries_invalid=1)], SecondChunkBad())
    assert not run.extract("concept", [spec])["n"].items and len(run.calls) == 4
    run = run_of(engine.Settings(raise_errors=False), [S.Model("r/x", context_tokens=3, retries_invalid=0)])
    run.extract("concept", [spec])
    assert "context" in run.calls[0]["error"]


def test_images_come_after_text():
    doc = document(2)
    doc.images = [("image/png", "QQ==")] * 3
    model = S.Model("r/x", role="extractor_multimodal")
    run = run_of(engine.Settings(images_per_call=2), [model], doc=doc)
    run.extract("concept", [S.BooleanConcept("b", "d", llm_role="extractor_multimodal", rule="zzz")])
    assert len(run.calls) == 3


def test_limiter():
    now, slept = [0.0], []
    limiter = backends.Limiter(3, 10, 1, lambda: now[0], lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)))
    for _ in range(7):
        limiter.acquire()
    assert slept == [10.0, 10.0]


def test_limiter_shared_by_tasks():
    for tasks, n, seconds in ((2, 1, 10), (3, 1, 10), (6, 1, 20), (30, 1, 100)):
        limiter = backends.Limiter(3, 10, tasks)
        assert (limiter.n, limiter.seconds) == (n, pytest.approx(seconds)) and tasks * limiter.n / limiter.seconds <= 3 / 10 + 1e-9


@pytest.fixture
def service():
    """A local completions service that answers what ``script`` says: (status, headers, body) one after another."""
    import http.server
    import threading

    script, seen = [], []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, dict(self.headers), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            status, headers, body = script.pop(0)
            self.send_response(status)
            for k, v in headers.items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1/", script, seen
    server.shutdown()


def said(text):
    return 200, {}, {"choices": [{"message": {"content": text}}], "usage": {"prompt_tokens": 1}}


def test_http_backend(service, monkeypatch):
    url, script, seen = service
    monkeypatch.setenv("LX_TEST_KEY", "k123")
    backend = backends.HttpBackend(url, "LX_TEST_KEY", retries=2, wait=0)
    payload = {"request": S.Model("acme/small").request(), "messages": [{"role": "user", "content": "p"}]}
    script += [(429, {"Retry-After": "0"}, {}), (503, {}, {}), said("[]")]
    assert backend.complete("p", payload) == "[]" and len(seen) == 3
    path, headers, body = seen[0]
    assert path == "/v1/chat/completions" and headers["Authorization"] == "Bearer k123"
    assert body == {"model": "small", "max_tokens": 4096, "temperature": 0.3, "messages": [{"role": "user", "content": "p"}]}
    script += [(400, {}, {"error": "temperature is not supported"}), (400, {}, {"error": "use max_completion_tokens, not max_tokens"}), said("x")]
    assert backend.complete("p", payload) == "x" and set(seen[-1][2]) == {"model", "messages"}  # each dropped once
    script += [(401, {}, {"error": "no"})]
    with pytest.raises(backends.Rejected):
        backend.complete("p", payload)
    script += [(500, {}, {})] * 3
    with pytest.raises(backends.CallFailed):
        backend.complete("p", payload)
    script += [(200, {}, {"choices": []})]
    with pytest.raises(backends.CallFailed):
        backend.complete("p", payload)
    with pytest.raises(backends.CallFailed):
        backends.HttpBackend("http://127.0.0.1:9", retries=1, wait=0).complete("p", {})


def test_http_backend_in_an_extraction(service, spark):
    url, script, seen = service
    reply = json.dumps([{"concept_id": "C0", "extracted_items": ["a"]}])
    script += [said("useless"), said(reply)]
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    got = extract.extract(docs, S.Pipeline(concepts=(S.StringConcept("S", "s"),)), [S.Model("acme/small")], {"extractor_text": backends.HttpBackend(url, wait=0)})
    assert got.items.first()["v_str"] == "a" and [r["attempt"] for r in got.ledger.orderBy("call_idx").collect()] == [0, 1]
    assert seen[0][2]["messages"][0]["role"] == "system" and "some text" in seen[0][2]["messages"][1]["content"]


def test_stored_replies_are_not_paid_again(tmp_path):
    calls = []

    class Once:
        def complete(self, prompt, payload):
            calls.append(prompt)
            return f"answer {len(calls)} é"

    backend = backends.StoredBackend(Once(), str(tmp_path / "replies"))
    assert backend.complete("p", {"attempt": 0}) == backend.complete("p", {"attempt": 0}) == "answer 1 é"
    assert backend.complete("p", {"attempt": 1}) == "answer 2 é" and backend.complete("q", {}) == "answer 3 é" and len(calls) == 3


def test_concurrent_calls_run_together_and_keep_their_order():
    import threading

    gate = threading.Barrier(4, timeout=10)

    class Slow:
        def complete(self, prompt, payload):
            gate.wait()  # passes only if four calls are under way
            return backends.RuleBackend().complete(prompt, payload)

    specs = [S.StringConcept(f"c{i}", f"d{i}", rule=f"x{i}") for i in range(4)]
    run = run_of(engine.Settings(concurrent=True), backend=Slow())
    found = run.extract("concept", specs)
    assert [found[f"c{i}"].items[0]["value"] for i in range(3)] == ["x0", "x1", "x2"] and len(run.calls) == 4
    assert all(f'["x{i}"]' in c["response"] and f"c{i} - d{i}" in c["prompt"] for i, c in enumerate(run.calls[:3]))
    with pytest.raises(engine.ExtractionFailed):
        run_of(engine.Settings(concurrent=True), backend=backends.ReplayBackend({}, ["bad"])).extract("concept", specs)


def test_chat_fallback_has_its_own_model_and_errors_are_caught():
    model = S.Model("a/b", retries_invalid=1, fallback=S.Model("a/c", is_fallback=True, retries_invalid=0))
    asked = []

    def broken(messages, allowed):
        asked.append("first")
        raise OSError("down")

    def second(messages, allowed):
        asked.append("second")
        return {"content": "here"}

    session = chat.Session()
    assert chat.chat(session, "hi", (broken, second), model) == "here" and asked == ["first", "first", "second"]
    assert [m["role"] for m in session.messages] == ["user", "assistant"]
    with pytest.raises(RuntimeError, match="down"):
        chat.chat(chat.Session(), "hi", (broken, broken), model)


def test_every_match_is_an_item():
    doc = engine.Document(1, "", ["a1 b22 c333", "d4444"], [[], []])
    number = S.NumericalConcept("n", "d", numeric_type="int", rule="[0-9]+")
    assert [i["value"] for i in run_of(engine.Settings(), doc=doc).extract("concept", [number])["n"].items] == [1, 22, 333, 4444]
    one = S.NumericalConcept("n", "d", numeric_type="int", rule={"pattern": "[0-9]+", "each": False})
    assert [i["value"] for i in run_of(engine.Settings(), doc=doc).extract("concept", [one])["n"].items] == [1, 4444]


def test_passages_in_documents(spark):
    docs = spark.createDataFrame([(1, "a long text with a passage in it"), (2, "nothing"), (3, None), (None, "a passage")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "a passage"), (11, "a passage"), (12, "passage in"), (13, "zzz"), (14, ""), (15, None)], "item_id long, passage string")
    want = [(i, d) for d, t in ((1, "a long text with a passage in it"), (2, "nothing"), (None, "a passage")) for i, p in ((10, "a passage"), (11, "a passage"), (12, "passage in"), (13, "zzz"), (14, "")) if p in t]
    assert sorted(map(tuple, score.passages_in(docs, items).collect()), key=str) == sorted(want, key=str)
    before, score.PASSAGE_CHARS = score.PASSAGE_CHARS, 5
    try:
        assert sorted(map(tuple, score.passages_in(docs, items).collect()), key=str) == sorted(want, key=str)
    finally:
        score.PASSAGE_CHARS = before


def test_extraction_tables(spark):
    docs = spark.createDataFrame([(1, "mail a@b.c\nnothing", "x"), (2, None, "y"), (3, "", "z"), (None, "a@b", "w")], "doc_id long, text string, owner string")
    p = S.Pipeline((S.Aspect("Mail", "m", rule="@"),), (S.DateConcept("D", "d", rule=r"\d-\d-\d{4}"),))
    model = S.Model("r/x", pricing=S.Pricing("0.4", "1.6"))
    got = extract.extract(docs, p, [model], {"extractor_text": backends.RuleBackend()})
    assert sorted((r["doc_id"] or 0, r["v_str"]) for r in got.items.collect()) == [(0, "a@b"), (1, "mail a@b.c")]
    assert got.status.where("processed").count() == 4 and got.ledger.count() == 4
    cost = ledger.cost(got.ledger, ledger.prices(spark, [model])).first()
    assert cost["cost_total"] == cost["cost_in"] + cost["cost_out"]
    with pytest.raises(S.SpecError):
        extract.check_unprocessed(got.status, ["aspect:Mail"])
    extract.check_unprocessed(got.status, ["aspect:Mail"], overwrite=True)
    assert extract.replaced(got.items, got.items.where("doc_id = 1")).count() == 1
    assert extract.extract(docs.limit(0), p, [model], {"extractor_text": backends.RuleBackend()}).items.count() == 0
    assert quality.unreferenced(got.items).count() == 0


def test_costs_round_each_side(spark):
    rows = spark.createDataFrame([("m/x", "extractor_text", False, 12_345, 1), ("m/y", "extractor_text", False, 10, 10)], "model string, llm_role string, is_fallback boolean, in_tokens long, out_tokens long")
    prices = spark.createDataFrame([("m/x", "extractor_text", False, Decimal("0.1"), Decimal("5"))], "model string, llm_role string, is_fallback boolean, price_in decimal(18,6), price_out decimal(18,6)")
    cost = ledger.cost(rows, prices).first()
    assert (cost["cost_in"], cost["cost_out"], cost["cost_total"]) == (Decimal("0.00123"), Decimal("0.00001"), Decimal("0.00124"))
    use = {r["model"]: (r["calls"], r["in_tokens"]) for r in ledger.usage(rows, prices).collect()}
    assert use == {"m/x": (1, 12_345), "m/y": (1, 0)}
    assert ledger.merged(ledger.usage(rows), ledger.usage(rows)).where("model = 'm/y'").first()["calls"] == 2
    with pytest.raises(ValueError):
        ledger.of_role(ledger.usage(rows), "reasoner_text")


def test_chat_sessions_and_tools():
    @chat.register_tool
    def double(n: int) -> str:
        """Twice a number."""
        return str(2 * n)

    @chat.register_tool
    def broken(n: int) -> str:
        """Fails."""
        raise KeyError(n)

    run = lambda name, args: chat.run_tool({"name": name, "arguments": args}, chat.TOOLS)
    assert run("double", '{"n": 2}') == "4" and "error" in run("double", "{") and "error" in run("double", '{"n": "x"}') and "KeyError" in run("broken", '{"n": 1}')
    with pytest.raises(chat.ToolError):
        run("nope", "{}")
    s = chat.Session()
    first = s.ask("hi", "sys")
    assert s.ask("hi") is first and len(s.messages) == 2
    with pytest.raises(ValueError):
        s.add({"role": "system", "content": "again"})
    model = S.Model("a/b", tools=("double",), tool_max_rounds=3)

    def complete(rounds):
        def go(messages, allowed):
            done = sum(m["role"] == "tool" for m in messages)
            return {"content": f"done {done}"} if done >= 2 * rounds else {"content": None, "tool_calls": [{"id": f"{done}-{i}", "name": "double", "arguments": '{"n": 1}'} for i in range(2)]}

        return go

    assert chat.chat(s, "hi", complete(3), model, parallel=True) == "done 6" and first["response_succeeded"]
    with pytest.raises(chat.ToolError):
        chat.chat(chat.Session(), "x", complete(4), model)
    with pytest.raises(RuntimeError):
        chat.chat(chat.Session(), "x", lambda m, a: None, model)
    bad = [{"role": "x"}, {"role": "tool", "content": "a"}, {"role": "user", "content": [{"type": "zip"}]}, {"role": "user", "content": "a", "tool_calls": [1]}, {"role": "assistant"}, {"role": "assistant", "content": "a", "response_succeeded": True}]
    assert all(map(chat.check_message, bad)) and chat.check_message({"role": "user", "content": [{"type": "text", "text": "a"}]}) is None


def test_scores(spark):
    assert score.judgement('{"rating": 4, "justification": "ok"}') == (4, "ok")
    for bad in (None, "x", "[]", '{"rating": 9}', '{"rating": "4"}', '{"rating": true}', '{"rating": 2.5}'):
        assert score.judgement(bad) == (0, "")
    rows = spark.createDataFrame([('{"rating": 4, "justification": "ok"}',), ("x",), ('{"rating": 9}',), ('{"rating": "4"}',), (None,)], "reply string")
    assert [(r["rating"], r["why"]) for r in score.judged(rows).collect()] == [(4, "ok"), (0, ""), (0, ""), (0, ""), (0, "")]
    items = spark.createDataFrame([("a", 1, "y"), ("a", 0, "x"), ("b", None, None)], "owner string, item_idx int, v string")
    assert {r["owner"]: r["block"] for r in score.items_block(items, ["owner"], "v").collect()} == {"a": "1. x\n2. y", "b": "No items extracted"}


def test_quality_rules(spark):
    docs = spark.createDataFrame([(1, "a b\nc"), (2, "​ "), (3, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in quality.blank(docs).collect()} == {2, 3}
    paras = spark.createDataFrame([(1, 0, "a b"), (1, 1, "zzz")], "doc_id long, para_idx int, raw_text string")
    assert [r["raw_text"] for r in quality.foreign_paragraphs(docs, paras).collect()] == ["zzz"]
    order = spark.createDataFrame([(1, "x y x", ["x", "y", "x"]), (2, "x y", ["y", "x"])], "doc_id long, text string, paras array<string>")
    assert {r["doc_id"]: r["in_order"] for r in segment.order_check(order).collect()} == {1: True, 2: False}
    specs = spark.createDataFrame([("a", None, "A", "x"), ("b", "a", "a", "y"), ("c", "b", "C", "z"), ("d", "q", "D", "w"), ("e", "a", "E", "v")], "aspect_id string, parent_id string, name string, description string")
    assert {r["aspect_id"] for r in quality.bad_nesting(specs).collect()} == {"b", "c", "d"}
    pics = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "a"), (2, 0, "a")], "doc_id long, img_idx int, base64 string")
    assert sorted(map(tuple, images.distinct_images(pics).collect())) == [(1, 0, "a"), (1, 1, "b"), (2, 0, "a")]


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:wps="http://schemas.microsoft.com/office/word/2010/wordprocessingShape"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def p(text, props="", run=""):
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr><w:t>{text}</w:t></w:r></w:p>"


def item(text, ident, level=0):
    return p(text, f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{ident}"/></w:numPr>')


def docx_bytes(body):
    parts = {
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{REL}/hyperlink" Target="https://e.x" TargetMode="External"/><Relationship Id="r2" Type="{REL}/header" Target="header1.xml"/><Relationship Id="r3" Type="{REL}/image" Target="media/a.jpg"/><Relationship Id="r4" Type="{REL}/image" Target="media/b.png"/></Relationships>',
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl><w:lvl w:ilvl="1"><w:numFmt w:val="lowerLetter"/></w:lvl></w:abstractNum><w:abstractNum w:abstractNumId="1"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="1"/></w:num></w:numbering>',
        "word/header1.xml": f"<w:hdr {W}>{p('TOP')}</w:hdr>",
        "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="0">{p("no")}</w:footnote><w:footnote w:id="1">{p("note")}</w:footnote></w:footnotes>',
        "word/comments.xml": f'<w:comments {W}><w:comment w:id="5" w:author="A B" w:date="2025">{p("remark")}</w:comment></w:comments>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
        z.writestr("word/media/a.jpg", b"\xff\xd8\xff1")
        z.writestr("word/media/b.png", b"\xff\xd8\xff1")
    return out.getvalue()


BODY = (
    p("Title", '<w:pStyle w:val="H2"/>') + p("strong", "", "<w:b/><w:i/>") + item("one", 1) + item("two", 1) + item("in", 1, 1) + item("three", 1) + item("in again", 1, 1) + item("dot", 2)
    + '<w:p><w:r><w:t>see </w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>here</w:t></w:r></w:hyperlink><w:r><w:footnoteReference w:id="1"/></w:r><w:del><w:r><w:delText>erased</w:delText></w:r></w:del></w:p>'
    + f"<w:del>{p('deleted')}</w:del><w:ins>{p('inserted')}</w:ins>"
    + '<w:p><w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> PAGE </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>7</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r></w:p>'
    + f"<w:p><w:r><mc:AlternateContent><mc:Choice><w:drawing><wps:txbx>{p('boxed')}</wps:txbx></w:drawing></mc:Choice><mc:Fallback><w:pict>{p('boxed')}</w:pict></mc:Fallback></mc:AlternateContent></w:r></w:p>"
    + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('bb')}</w:tc></w:tr><w:tr><w:tc>{p('ccc')}</w:tc><w:tc><w:tbl><w:tr><w:tc>{p('n')}</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>"
)


def test_docx():
    data = docx_bytes(BODY)
    md = docx.as_text(data).split("\n\n")
    assert md[:9] == ["**Header**: TOP", "## Title", "***strong***", "1. one", "2. two", "    1. in", "3. three", "    1. in again", "- dot"]
    assert md[9:12] == ["see [here](https://e.x)[Footnote 1]", "inserted", "boxed"]
    assert md[12].splitlines()[:2] == ["| a   | bb  |", "| --- | --- |"] or md[12].startswith("| a   | bb")
    assert md[13:] == ["**Footnote 1**: note", "**Comment 5 (by A B)**: remark"]
    raw = docx.as_text(data, markdown=False).split("\n\n")
    assert "erased" not in "".join(raw) and "7" not in raw and raw.count("boxed") == 1
    ctx = {x.text: x.context for x in docx.parts(data)}
    assert ctx["two"] == "Style: Normal, List Type: Numbered, List Level: 0, List Format: Decimal, List ID: 1"
    assert ctx["bb"].startswith("Style: Normal, Table ID: 1, Row: 1, Column: 2, Table Cell") and "Author: A B" in ctx["remark"]
    plain = docx.Options(tables=False, comments=False, footnotes=False, headers=False, textboxes=False, links=False, inline=False)
    assert docx.as_text(data, True, plain).split("\n\n")[:2] == ["## Title", "strong"]
    assert len(docx.Package.open(data).images()) == 1
    with pytest.raises(docx.DocxFormatError):
        docx.parts(b"no zip")


def test_docx_as_a_table(spark, tmp_path):
    (tmp_path / "good.docx").write_bytes(docx_bytes(BODY))
    (tmp_path / "bad.docx").write_bytes(b"nope")
    (tmp_path / "other.txt").write_bytes(b"nope")
    rows = docx.read(spark, str(tmp_path))
    assert rows.where("error IS NOT NULL").count() == 1
    assert docx.whole_texts(rows).first()["text"] == docx.as_text(docx_bytes(BODY))
    assert docx.images(spark, str(tmp_path / "good.docx")).count() == 1


def test_pages_and_images(spark, tmp_path):
    page = spark.createDataFrame([(1, "u", '<h2>A &amp;amp; B</h2><script>"</p>"</script><p>x<p>y<a href="/q">z</a><a href="/q">z</a>')], "page_id long, url string, html string")
    assert html.headings(page).first()["md"] == "## A &amp; B"
    assert [r["href"] for r in html.links(page).collect()] == ["/q"]
    assert [r["raw_text"] for r in segment.paragraphs(html.documents(page)).collect()] == ["A &amp; B", "x", "yzz"]
    (tmp_path / "a.bin").write_bytes(b"\x89PNG\r\n\x1a\nrest")
    (tmp_path / "b.bin").write_bytes(b"text")
    got = images.read(spark, str(tmp_path)).collect()
    assert [r["mime_type"] for r in got] == ["image/png"]


def test_streams_equal_batch(spark, tmp_path):
    schema = spark.read.parquet(f"{SMALL}/events.parquet").schema
    source = spark.read.parquet(f"{SMALL}/events.parquet").orderBy("ts")
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = streams.tumbling(stream, "ts", "event_type", "value", "1 hour").writeStream.outputMode("complete").format("memory").queryName("tumbled").trigger(availableNow=True).start()
    query.awaitTermination()
    key = lambda r: (r["start"], r["event_type"], r["n"])
    assert sorted(map(key, spark.table("tumbled").collect())) == sorted(map(key, streams.tumbling(source, "ts", "event_type", "value", "1 hour").collect()))
    once = streams.first_seen(stream.unionByName(stream), "ts", ["event_id"])
    streams.run_available(once, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == source.count()
    talk = spark.read.parquet(f"{SMALL}/conversations.parquet")
    talk.write.parquet(str(tmp_path / "talk"))
    state = streams.chat_state(spark.readStream.schema(talk.schema).parquet(str(tmp_path / "talk")))
    query = state.writeStream.outputMode("update").format("memory").queryName("talked").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["conv_id"]: r["n_turns"] for r in spark.table("talked").collect()} == {r["conv_id"]: r["count"] for r in talk.groupBy("conv_id").count().collect()}
    assert streams.sessions(source, "ts", "user_id").count() > 0 and streams.sliding(source, "ts", "event_type").count() > 0


def test_a_bad_file_does_not_end_the_pictures(spark, tmp_path):
    (tmp_path / "good.docx").write_bytes(docx_bytes(BODY))
    (tmp_path / "bad.docx").write_bytes(b"nope")
    got = docx.images(spark, str(tmp_path)).collect()
    assert sorted((r["error"] is None, r["mime_type"]) for r in got) == [(False, None), (True, "image/jpeg")]


def test_prices_from_a_table(spark, tmp_path):
    at = tmp_path / "prices.json"
    at.write_text('{"acme/one": {"input_cost_per_token": 4e-07, "output_cost_per_token": 1.6e-06}, "two": {"input_cost_per_token": 1e-06, "output_cost_per_token": 2e-06}, "sample_spec": "x", "half": {"input_cost_per_token": 1}}')
    table = ledger.price_table(str(at))
    assert ledger.priced(S.Model("acme/one", auto_pricing=True), table) == S.Pricing("0.4", "1.6")
    assert ledger.priced(S.Model("other/two", auto_pricing=True), table) == S.Pricing(1, 2) and ledger.priced(S.Model("acme/one"), table) is None
    for model, held in ((S.Model("acme/none", auto_pricing=True), table), (S.Model("acme/one", auto_pricing=True), None)):
        with pytest.raises(S.SpecError):
            ledger.priced(model, held)
    rows = spark.createDataFrame([("acme/one", "extractor_text", False, 1000, 10), ("acme/x", "reasoner_text", False, 5, 5)], "model string, llm_role string, is_fallback boolean, in_tokens long, out_tokens long")
    cost = ledger.cost(rows, ledger.prices(spark, [S.Model("acme/one", auto_pricing=True)], table)).first()
    assert cost["cost_in"] == Decimal("0.0004") and cost["cost_out"] == Decimal("0.00002")
    assert ledger.reset(rows).count() == 0 and [r["model"] for r in ledger.reset(rows, "extractor_text").collect()] == ["acme/x"]


def test_sentence_splitters(spark):
    from lexiloom.functions import text as T

    para = 'Dr. Smith met J. Doe at 3.15 p.m. on Monday. "Really?" he said! 今日は晴れ。明日は雨！ Ende'
    docs = spark.createDataFrame([(1, para), (2, None)], "doc_id long, text string")
    got = [r["raw_text"] for r in segment.sentences(docs, split=T.sentences_by_marks).orderBy("sent_idx").collect()]
    assert got == ["Dr. Smith met J. Doe at 3.15 p.m. on Monday.", '"Really?" he said!', "今日は晴れ。", "明日は雨！", "Ende"]

    def make():
        return lambda texts: [[t[:5], t[5:]] for t in texts]

    rows = segment.sentences(docs.where("doc_id = 1"), split=segment.trained_splitter(make)).orderBy("sent_idx").collect()
    assert [r["raw_text"] for r in rows] == [para[:5].strip(), para[5:].strip()]
    own = extract.extract(docs, S.Pipeline((S.Aspect("A", "a", rule="mith", reference_depth="sentences"),)), [S.Model("r/x")], {"extractor_text": backends.RuleBackend()}, split=segment.trained_splitter(make))
    assert [r["v_str"] for r in own.items.collect()] == [para[5:].strip()]


def test_benchmark_from_items_to_score(spark, tmp_path):
    items = spark.createDataFrame([(1, "aspect:A"), (1, "aspect:A"), (1, "aspect:C"), (2, "aspect:A")], "doc_id long, owner string")
    at = tmp_path / "bench.json"
    at.write_text(json.dumps([{"doc_id": 1, "text": "t", "targets": [{"owner": "aspect:A", "category": "simple", "wanted": True}, {"owner": "aspect:B", "category": "simple", "wanted": True}, {"owner": "aspect:C", "category": "simple", "wanted": False}, {"owner": "aspect:D", "category": "simple", "wanted": False}]}, {"doc_id": 2, "text": "u", "targets": [{"owner": "aspect:A", "category": "hard", "wanted": True}]}]))
    targets = score.read_targets(spark, str(at))
    assert targets.count() == 5
    replies = spark.createDataFrame([(1, "aspect:A", '{"rating": 4, "justification": "x"}'), (2, "aspect:A", "broken")], "doc_id long, owner string, reply string")
    got = {r["category"]: (r["must_have"], r["must_not_have"], r["rating_percent"], r["overall"]) for r in score.benchmark(items, targets, replies).collect()}
    assert got == {"simple": (50.0, 50.0, 80.0, 65.0), "hard": (100.0, 0.0, 0.0, 25.0)}
    assert {r["category"]: r["overall"] for r in score.benchmark(items, targets).collect()} == {"simple": 50.0, "hard": 50.0}


def test_logger(monkeypatch):
    from lexiloom.operators import logs

    out = io.StringIO()
    log = logs.logger("lexiloom.test", "trace", out)
    log.trace("t %s", 1), log.success("s"), log.debug("d")
    assert [x.split("|")[1].strip() for x in out.getvalue().splitlines()] == ["TRACE", "SUCCESS", "DEBUG"]
    monkeypatch.setenv("LEXILOOM_LOG_LEVEL", "warning")
    log = logs.logger("lexiloom.test")
    log.success("no"), log.warning("w")
    assert out.getvalue().count("\n") == 4 and len(log.handlers) == 1
    assert logs.logger("lexiloom.test", "off").disabled
    with pytest.raises(ValueError):
        logs.logger("lexiloom.test", "loud")


def test_templates():
    from lexiloom.plans import prompts, templates

    text = "{# remark #}\n{% for s in specs %}\n{{ loop.index }}. {{ s.name }}{% if not loop.last %};{% endif %}\n{% endfor %}\n{% if kind == 'aspect' and numbered %}A{% elif whole %}B{% else %}C{% endif %} {{ rows[1].x }}"
    values = {"specs": [{"name": "one"}, {"name": "two"}], "kind": "concept", "numbered": True, "whole": None, "rows": [{"x": 1}, {"x": "y"}]}
    assert templates.render(text, values) == "1. one;\n2. two\nC y"
    assert templates.render(text, values | {"kind": "aspect"}).endswith("A y") and templates.render(text, values | {"whole": "w"}).endswith("B y")
    for bad in ("{% for x in %}{% endfor %}", "{% if a %}", "{% while a %}", "{{ nothing }}", "{% if a ~ b %}{% endif %}", "{{ rows[7] }}"):
        with pytest.raises(templates.TemplateError):
            templates.render(bad, values)
    own = "Answer as {{ shape }}\n{% for s in specs %}\n{{ s.id }} {{ s.name }}: {{ s.description }}\n{% endfor %}\n{% for p in paragraphs %}\n{% if numbered %}[{{ p.number }}] {% endif %}{{ p.text }}\n{% endfor %}"
    spec = S.StringConcept("n", "d", rule="x[46]", add_references=True)
    run = run_of(engine.Settings(paragraphs_per_call=3, render=own))
    assert [i["paras"] for i in run.extract("concept", [spec])["n"].items] == [[4], [6]]
    assert run.calls[1]["prompt"].startswith('Answer as [{"concept_id"') and "C0 n: d\n[0] x3\n[1] para 4 x4\n[2] para 5 x5\n" in run.calls[1]["prompt"]
    with pytest.raises(templates.TemplateError):
        prompts.renderer("{% if a %}")


def test_markdown_is_shown_where_all_paragraphs_have_it(spark):
    doc = engine.Document(1, "a\n\nb\n\nc", ["a", "b", "c"], [[], [], []], md=["# a", "**b**", None])
    run = run_of(engine.Settings(paragraphs_per_call=2), doc=doc)
    run.extract("aspect", [S.Aspect("A", "a", rule="[abc]")])
    assert "P0: # a" in run.calls[0]["prompt"] and "P1: **b**" in run.calls[0]["prompt"] and "P0: c" in run.calls[1]["prompt"]
    whole = engine.Document(1, "a\n\nb", ["a", "b"], [[], []], md=["# a", "**b**"])
    run = run_of(engine.Settings(), doc=whole)
    found = run.extract("concept", [S.StringConcept("C", "c", rule="[ab]")])["C"]
    assert "# a\n\n**b**" in run.calls[0]["prompt"] and [i["value"] for i in found.items] == ["a", "b"]
    docs = spark.createDataFrame([(1, None, ["x @", "line one\nline two @"], ["**x** @", "y @"]), (2, None, None, None)], "doc_id long, text string, paras array<string>, md_paras array<string>")
    got = extract.extract(docs, S.Pipeline((S.Aspect("A", "a", rule="@"),)), [S.Model("r/x")], {"extractor_text": backends.RuleBackend()})
    assert sorted(r["v_str"] for r in got.items.collect()) == ["line one\nline two @", "x @"] and "P0: **x** @" in got.ledger.first()["prompt"]
