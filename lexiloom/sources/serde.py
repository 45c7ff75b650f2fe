"""Documents, specs and results as JSON and back."""

from __future__ import annotations

import dataclasses
import json
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.structure import to_dict, type_of, type_text
from lexiloom.operators.segment import unrolled
from lexiloom.plans.specs import Aspect, Concept, Group, Model, Pipeline, Pricing, SpecError

CLASSES = {c.__name__: c for c in (Aspect, Concept, Pipeline, Model, Group, Pricing)}
#: Fields that are never written.
SECRET = ("api_key", "api_base")


def documents_json(docs: DataFrame, paras: str = "paras") -> DataFrame:
    """(doc_id, json) of documents with an array of paragraphs, non-ASCII kept. Narrow."""
    held = F.transform(paras, lambda p: F.struct(p.alias("raw_text"))).alias("paragraphs")
    return docs.select("doc_id", F.to_json(F.struct(F.lit("Document").alias("class"), "doc_id", held)).alias("json"))


def documents_from_json(rows: DataFrame) -> DataFrame:
    """(doc_id, para_idx, raw_text) of such JSON; rows of another class are an error."""
    parsed = F.from_json("json", "class string, doc_id long, paragraphs array<struct<raw_text:string>>")
    checked = F.when(parsed["class"] == "Document", parsed).otherwise(F.raise_error(F.lit("not a document")).cast(rows.select(parsed.alias("x")).schema["x"].dataType))
    found = rows.select(checked.alias("d")).select("d.doc_id", "d.paragraphs")
    return unrolled(found, ["doc_id"], F.col("paragraphs"), "para_idx", "p").select("doc_id", "para_idx", "p.raw_text")


def to_plain(x):
    """A spec as JSON values, with its class's name."""
    if dataclasses.is_dataclass(x):
        out = {"class": type(x).__name__}
        for f in dataclasses.fields(x):
            if f.name not in SECRET:
                v = getattr(x, f.name)
                out[f.name] = to_text(v) if f.name == "structure" and v is not None else to_plain(v)
        return out
    if isinstance(x, (list, tuple)):
        return [to_plain(v) for v in x]
    if isinstance(x, dict):
        return {k: to_plain(v) for k, v in x.items()}
    return {"decimal": str(x)} if isinstance(x, Decimal) else x


def to_text(structure) -> str:
    return type_text(to_dict(structure))


def from_plain(x, want: str | None = None):
    """The spec of such values; checked as if it were newly made."""
    if isinstance(x, list):
        return tuple(from_plain(v) for v in x)
    if not isinstance(x, dict):
        return x
    if set(x) == {"decimal"}:
        return Decimal(x["decimal"])
    if "class" not in x:
        return {k: from_plain(v) if isinstance(v, dict) else v for k, v in x.items()}
    if x["class"] not in CLASSES or (want and x["class"] != want):
        raise SpecError(f"expected {want or 'a known class'}, found {x['class']}")
    fields = {k: v for k, v in x.items() if k != "class"}
    made = {k: type_of(v) if k == "structure" and v is not None else v if k in ("rule", "custom_data") else from_plain(v) for k, v in fields.items()}
    return CLASSES[x["class"]](**made)


def to_json(x) -> str:
    return json.dumps(to_plain(x), ensure_ascii=False, indent=2)


def from_json(text: str, want: str | None = None):
    return from_plain(json.loads(text), want)


def to_disk(x, path: str) -> None:
    if not path.endswith(".json"):
        raise ValueError("the file's name ends in .json")
    with open(path, "w", encoding="utf-8") as f:
        f.write(to_json(x))


def from_disk(path: str, want: str | None = None):
    if not path.endswith(".json"):
        raise ValueError("the file's name ends in .json")
    with open(path, encoding="utf-8") as f:
        return from_json(f.read(), want)
