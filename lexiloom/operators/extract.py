"""Extraction over a corpus: one narrow stage from documents to items, status and call ledger.

Paragraphs and sentences are array expressions in the document's own row, the
pipeline is a small constant, and references are resolved where the reply is read;
so nothing is shuffled. What calls gave is written once and read for all three
tables, so a second action makes no call again. A task that fails or runs twice
repeats its documents' calls, unless their backend keeps replies (``StoredBackend``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexiloom.functions import envelope
from lexiloom.functions import text as T
from lexiloom.operators import engine, runtime, segment
from lexiloom.operators.backends import Limiter
from lexiloom.plans.specs import Model, Pipeline, need

RESULT = (
    "kind string, doc_id long, owner string, owner_kind string, item_idx int, v_str string, v_bool boolean, v_int long, v_float double, v_date date, "
    "v_labels array<string>, v_json string, justification string, ref_paras array<int>, ref_sents array<struct<p:int,s:int>>, processed boolean, "
    "call_idx int, llm_role string, model string, is_fallback boolean, attempt int, prompt string, response string, in_tokens long, out_tokens long, error string"
)
VALUES = ("v_str", "v_bool", "v_int", "v_float", "v_date", "v_labels", "v_json")


@dataclass
class Extraction:
    """Items, status of every spec, and the ledger of calls, all read from one written table."""

    table: DataFrame
    path: str

    @property
    def items(self) -> DataFrame:
        return self.table.where("kind = 'item'").select("doc_id", "owner", "owner_kind", "item_idx", *VALUES, "justification", "ref_paras", "ref_sents")

    @property
    def status(self) -> DataFrame:
        return self.table.where("kind = 'status'").select("doc_id", "owner", "owner_kind", "processed", "ref_paras", "ref_sents")

    @property
    def ledger(self) -> DataFrame:
        return self.table.where("kind = 'call'").select("doc_id", "call_idx", "llm_role", "model", "is_fallback", "attempt", "prompt", "response", "in_tokens", "out_tokens", "error")

    @property
    def errors(self) -> DataFrame:
        return self.table.where("kind = 'error'").select("doc_id", "error")


@lru_cache(maxsize=64)
def _limiter(model: str, n: int, seconds: float, tasks: int) -> Limiter:
    return Limiter(n, seconds, tasks)


def _rows(doc: engine.Document, run: engine.Run, found) -> list[dict]:
    rows = []
    for owner, spec, f in found:
        kind = "aspect" if getattr(spec, "kind", "") == "aspect" else spec.kind
        places, deep = engine.rolled_up(f, spec.reference_depth, doc.sents) if kind == "aspect" else ([], [])
        rows.append({"kind": "status", "doc_id": doc.doc_id, "owner": owner, "owner_kind": kind, "processed": f.processed, "ref_paras": places, "ref_sents": [{"p": p, "s": s} for p, s in deep]})
        for i, item in enumerate(f.items):
            rows.append({"kind": "item", "doc_id": doc.doc_id, "owner": owner, "owner_kind": kind, "item_idx": i, "justification": item["justification"], "ref_paras": item["paras"], "ref_sents": [{"p": p, "s": s} for p, s in item["sents"]]} | envelope.columns_of(item["value"]))
    rows += [{"kind": "call", "doc_id": doc.doc_id, "call_idx": i, "llm_role": c["role"]} | {k: c[k] for k in ("model", "is_fallback", "attempt", "prompt", "response", "in_tokens", "out_tokens", "error")} for i, c in enumerate(run.calls)]
    return rows + [{"kind": "error", "doc_id": doc.doc_id, "error": e} for e in run.errors]


def extract(
    docs: DataFrame,
    pipeline: Pipeline,
    models: list[Model],
    backends: dict,
    settings: engine.Settings = engine.Settings(raise_errors=False),  # noqa: B008
    what: str = "all",
    text: str = "text",
    path: str | None = None,
    keep_prompts: bool = True,
    split=T.sentences,
) -> Extraction:
    """Run a pipeline on every document.

    ``what``: all, aspects or concepts. ``backends``: role -> backend or (backend,
    fallback's backend). ``docs`` may have images (array<struct<mime,data>>), paras
    (array<string>: the document is given as paragraphs, its text is not split) and with
    these md_paras (their Markdown, for prompts). Null text has no paragraphs. A document without a valid reply is a row of
    ``errors``; with ``raise_errors`` it ends the job. ``split`` cuts a paragraph
    into sentences (a Column to an array of strings). With ``throttle`` all tasks
    together keep each model's rate.
    """
    need(what in ("all", "aspects", "concepts"), "what is all, aspects or concepts")
    by_role = {m.role: m for m in models}
    need(len(by_role) == len(models), "models have different roles")
    pairs = {r: b if isinstance(b, tuple) else (b, None) for r, b in backends.items()}
    runtime.prepare(docs.sparkSession)
    given = "paras" in docs.columns
    paras = F.coalesce(F.col("paras") if given else T.paragraphs(F.col(text)), F.array().cast("array<string>"))
    whole = F.coalesce(F.col(text), F.array_join("paras", "\n\n") if given else F.lit(""), F.lit(""))
    more = [c for c in ("images", *(["md_paras"] if given else [])) if c in docs.columns]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole.alias("text"), paras.alias("paras"), *more)
    sents = (split.of_array(F.col("paras")) if hasattr(split, "of_array") else F.transform("paras", split)) if pipeline.needs_sentences else F.array().cast("array<array<string>>")
    rows = rows.withColumn("sents", sents)
    schema = to_arrow_schema(StructType.fromDDL(RESULT))
    tasks = max(1, docs.sparkSession.sparkContext.defaultParallelism)

    def work(batches):
        limiter = (lambda m: _limiter(m.model, *m.rate, tasks)) if settings.throttle else None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                images = [(i["mime"], i["data"]) for i in row.get("images") or []]
                doc = engine.Document(row["doc_id"], row["text"], row["paras"], row["sents"], images, row.get("md_paras") or [])
                run = engine.Run(doc, by_role, pairs, settings, limiter, keep_prompts)
                found = run.all(pipeline) if what == "all" else run.aspects(pipeline.aspects) if what == "aspects" else run.concepts(pipeline.concepts)
                if not keep_prompts:
                    for c in run.calls:
                        c["prompt"] = None
                out += _rows(doc, run, found)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in out], f.type) for f in schema], schema=schema)

    path = path or runtime.shared_dir(docs.sparkSession, "extraction")
    return Extraction(runtime.written(rows.mapInArrow(work, RESULT), path), path)


def check_unprocessed(status: DataFrame, owners: list[str], overwrite: bool = False) -> None:
    """An error if one of the owners was processed already and must not be overwritten."""
    found = status.where(F.col("owner").isin(owners) & F.col("processed")).limit(1).count()
    need(overwrite or not found, "processed already; use overwrite")


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Items with those of the owners in ``new`` put in place of theirs."""
    return old.join(new.select("owner").distinct(), "owner", "left_anti").unionByName(new)


def call_plan(docs: DataFrame, pipeline: Pipeline, models: list[Model], settings: engine.Settings = engine.Settings()) -> DataFrame:  # noqa: B008
    """Planned calls of each document's own aspects and concepts, without making them: (doc_id, owner_kind, llm_role, spec_chunk, text_chunk, specs)."""
    plan = []
    for kind, specs in (("aspect", pipeline.aspects), ("concept", pipeline.concepts)):
        for m in models:
            plan += [(kind, m.role, i, [s.name for s in chunk]) for i, chunk in enumerate(engine.spec_chunks([s for s in specs if s.llm_role == m.role], settings))]
    chunks = F.broadcast(docs.sparkSession.createDataFrame(plan, "owner_kind string, llm_role string, spec_chunk int, specs array<string>"))  # the pipeline's own few rows
    size = settings.paragraphs_per_call
    first = segment.paragraphs(docs).where(F.col("para_idx") % size == 0 if size else F.col("para_idx") == 0)  # of each chunk; splits the text once
    return first.select("doc_id", segment.chunk_of(F.col("para_idx"), size).alias("text_chunk")).crossJoin(chunks)
