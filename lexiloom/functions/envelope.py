"""Replies of a model: parse, check against the envelope of the call, turn values into typed items.

Plain Python, as the checks decide inside a call whether it is asked again. Whatever
is wrong makes the whole reply invalid (``Invalid``).
"""

from __future__ import annotations

import datetime as dt
import json
import math
import re
import unicodedata

from lexiloom.functions.structure import compile_structure

THINK = re.compile(r"^\s*<think>.*?</think>", re.DOTALL)
FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.DOTALL)
CONTROL = re.compile("[\x00-\x1f\x7f-\x9f\u200b-\u200f\u2028-\u202f\ufeff]")
ID = {k: re.compile(rf"^{k}+(\d+)$") for k in "ACP"}
SENT_ID = re.compile(r"^P+\d+-S(\d+)$")


class Invalid(ValueError):
    """A reply, or a value in it, that cannot be used."""


def parse(reply: str | None):
    """The JSON array or object of a reply; None for anything else."""
    if reply is None:
        return None
    text = THINK.sub("", reply).strip()
    for candidate in (text, *(m[1] for m in [FENCE.search(text)] if m)):
        try:
            value = json.loads(candidate)
        except (ValueError, RecursionError):
            continue
        return value if isinstance(value, (list, dict)) else None
    return None


def keys(obj, *names: str) -> tuple:
    """The values of exactly these keys."""
    if not isinstance(obj, dict) or set(obj) != set(names):
        raise Invalid(f"expected the keys {names}")
    return tuple(obj[n] for n in names)


def listed(x) -> list:
    if not isinstance(x, list):
        raise Invalid("expected a list")
    return x


def string(x) -> str:
    if not isinstance(x, str):
        raise Invalid("expected a string")
    return x


def index(token, kind: str, n: int) -> int:
    """Position behind an id such as P3; it must be one of ``n``."""
    m = ID[kind].match(string(token))
    if not m or int(m[1]) >= n:
        raise Invalid(f"no such id: {token!r}")
    return int(m[1])


def sentence_index(token, n: int) -> int:
    m = SENT_ID.match(string(token))
    if not m or int(m[1]) >= n:
        raise Invalid(f"no such sentence: {token!r}")
    return int(m[1])


def date_of(text) -> dt.date:
    m = re.fullmatch(r"(\d{1,2})-(\d{1,2})-(\d{4})", string(text).strip())
    try:
        return dt.date(int(m[3]), int(m[2]), int(m[1]))
    except (TypeError, ValueError):
        raise Invalid(f"not a date: {text!r}") from None


def json_object(x) -> dict:
    """An object with a key at least, no empty inner object, JSON values only."""

    def walk(v, top=False):
        if isinstance(v, dict):
            if not v:
                raise Invalid("an empty object")
            for k, inner in v.items():
                if not isinstance(k, str):
                    raise Invalid("a key that is no string")
                walk(inner)
        elif isinstance(v, list):
            for inner in v:
                walk(inner)
        elif isinstance(v, float) and not math.isfinite(v):
            raise Invalid("not a JSON number")

    if not isinstance(x, dict):
        raise Invalid("not an object")
    walk(x)
    return x


def value_of(spec, raw):
    """The typed value of a concept from the reply's value."""
    kind = spec.kind
    if kind == "string":
        out = string(raw).strip()
        if not out:
            raise Invalid("an empty string")
        return out
    if kind == "boolean":
        if not isinstance(raw, bool):
            raise Invalid("not a boolean")
        return raw
    if kind == "numerical":
        if isinstance(raw, bool) or not isinstance(raw, (int, float)):
            raise Invalid("not a number")
        if spec.numeric_type == "int" and not isinstance(raw, int):
            raise Invalid("not an integer")
        return float(raw) if spec.numeric_type == "float" else raw
    if kind == "rating":
        if isinstance(raw, bool) or not isinstance(raw, int) or not spec.rating[0] <= raw <= spec.rating[1]:
            raise Invalid("not a rating on the scale")
        return raw
    if kind == "date":
        return date_of(raw)
    if kind == "label":
        (labels,) = keys(raw, "labels")
        if not listed(labels) or any(not isinstance(x, str) or x not in spec.labels for x in labels):
            raise Invalid("labels outside the set")
        if len({x.lower() for x in labels}) != len(labels) or (spec.classification == "multi_class" and len(labels) > 1):
            raise Invalid("too many labels")
        return labels
    value = json_object(raw)
    if why := compile_structure(spec.structure)(value):
        raise Invalid(why)
    return value


def columns_of(value) -> dict:
    """The one value column of the items table that a typed value goes to."""
    if isinstance(value, bool):
        return {"v_bool": value}
    if isinstance(value, int):
        return {"v_int": value} if -(2**63) <= value < 2**63 else {"v_str": str(value)}
    if isinstance(value, float):
        return {"v_float": value}
    if isinstance(value, dt.date):
        return {"v_date": value}
    if isinstance(value, list):
        return {"v_labels": value}
    return {"v_json": json.dumps(value, ensure_ascii=False)} if isinstance(value, dict) else {"v_str": value}


def aspect_items(reply, specs, paras, sents, params) -> dict[int, list[dict]]:
    """Spec number -> items of an aspects reply. ``paras`` and ``sents`` are the chunk's texts."""
    by_sentence, justified = params["reference_depth"] == "sentences", params["add_justifications"]
    out: dict[int, list[dict]] = {}
    for entry in listed(reply):
        flat = not by_sentence and not justified
        a, found = keys(entry, "aspect_id", "paragraph_ids" if flat else "paragraphs")
        items = out.setdefault(index(a, "A", len(specs)), [])
        if flat:
            rows = [(index(p, "P", len(paras)), None, None) for p in listed(found)]
        elif not by_sentence:
            rows = [(index(p, "P", len(paras)), None, string(j)) for p, j in (keys(x, "paragraph_id", "justification") for x in listed(found))]
        else:
            rows = []
            for x in listed(found):
                p, ss = keys(x, "paragraph_id", "sentences")
                p = index(p, "P", len(paras))
                for s in listed(ss):
                    got = keys(s, "sentence_id", "justification") if justified else (*keys(s, "sentence_id"), None)
                    rows.append((p, sentence_index(got[0], len(sents[p])), got[1] and string(got[1])))
        for p, s, j in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1])):
            items.append({"value": paras[p] if s is None else sents[p][s], "justification": j, "paras": [p], "sents": [] if s is None else [(p, s)]})
    return out


def concept_items(reply, specs, paras, sents, params) -> dict[int, list[dict]]:
    """Spec number -> items of a concepts reply."""
    refs, justified = params["add_references"], params["add_justifications"]
    deep = refs and params["reference_depth"] == "sentences"
    names = ["value", *(["justification"] if justified else []), *(["reference_paragraphs" if deep else "reference_paragraph_ids"] if refs else [])]
    out: dict[int, list[dict]] = {}
    for entry in listed(reply):
        c, found = keys(entry, "concept_id", "extracted_items")
        n = index(c, "C", len(specs))
        items = out.setdefault(n, [])
        for x in listed(found):
            got = {"value": x} if len(names) == 1 else dict(zip(names, keys(x, *names)))
            item = {"value": value_of(specs[n], got["value"]), "justification": string(got["justification"]) if justified else None, "paras": [], "sents": []}
            if deep:
                for r in listed(got["reference_paragraphs"]):
                    p, ss = keys(r, "reference_paragraph_id", "reference_sentence_ids")
                    p = index(p, "P", len(paras))
                    item["paras"].append(p)
                    item["sents"] += [(p, sentence_index(s, len(sents[p]))) for s in listed(ss)]
            elif refs:
                item["paras"] = [index(p, "P", len(paras)) for p in listed(got["reference_paragraph_ids"])]
            item["paras"], item["sents"] = sorted(set(item["paras"])), sorted(set(item["sents"]))
            items.append(item)
    return out


def is_space(c: str) -> bool:
    return c.isspace() or unicodedata.category(c) == "Zs"


def clean(text: str, keep_linebreaks: bool = True) -> str:
    """``functions.text.clean_for_prompt`` for one string."""
    if keep_linebreaks:
        text = re.sub(r"\r\n|\r", "\n", text)
        text = re.sub("[\x00-\x09\x0b-\x1f\x7f-\x9f\u200b-\u200f\u2028-\u202f\ufeff]", "", text)
        return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text)).strip()
    return re.sub(r"\s+", " ", CONTROL.sub("", text)).strip()
