"""Integrity rules as queries: each gives the rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as T
from lexiloom.operators import segment


def blank(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents without text, or with nothing but controls and white space."""
    return docs.where(F.col(text).isNull() | T.is_blank(F.col(text)))


def foreign_paragraphs(docs: DataFrame, paras: DataFrame, text: str = "text") -> DataFrame:
    """Paragraphs that do not occur in their document's text."""
    return paras.join(docs.select("doc_id", text), "doc_id").where(~F.contains(F.col(text), F.col("raw_text"))).select("doc_id", "para_idx", "raw_text")


def out_of_order(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents whose own paragraphs do not follow one another in the text."""
    return segment.order_check(segment.with_paragraphs(docs, text), text=text).where("NOT in_order").select("doc_id")


def foreign_sentences(paras: DataFrame, sents: DataFrame) -> DataFrame:
    """Sentences that do not occur in their paragraph."""
    p = paras.withColumnRenamed("raw_text", "para")
    return sents.join(p, ["doc_id", "para_idx"]).where(~F.contains("para", "raw_text")).select("doc_id", "para_idx", "sent_idx")


def repeated_values(rows: DataFrame, key: str, by: list[str], fold_case: bool = True) -> DataFrame:
    """Values of ``key`` that stand more than once in a group (names, images, labels, ids)."""
    value = F.lower(key) if fold_case else F.col(key)
    return rows.groupBy(*by, value.alias(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def first_of_each(rows: DataFrame, key: str, by: list[str], order: str) -> DataFrame:
    """Rows without later repeats of ``key`` in a group: pre-aggregated, no window."""
    best = rows.groupBy(*by, key).agg(F.min(order).alias(order))
    return rows.join(best, [*by, key, order], "left_semi").select(rows.columns)


def empty_documents(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Documents that have none of text, paragraphs and images."""
    missing = F.lit(True)
    for c in columns:
        missing = missing & F.col(c).isNull()
    return docs.where(missing)


def unreferenced(items: DataFrame) -> DataFrame:
    """Aspect items without a paragraph."""
    return items.where("owner_kind = 'aspect' AND (ref_paras IS NULL OR size(ref_paras) = 0)")


def bad_nesting(specs: DataFrame) -> DataFrame:
    """Sub-aspects whose parent is missing, is a sub-aspect itself, or shares their name or description."""
    s, p = specs.alias("s"), specs.alias("p")
    joined = s.where("s.parent_id IS NOT NULL").join(p, F.expr("s.parent_id = p.aspect_id"), "left")
    return joined.where("p.aspect_id IS NULL OR p.parent_id IS NOT NULL OR lower(s.name) = lower(p.name) OR lower(s.description) = lower(p.description)").select("s.aspect_id")


def bad_messages(messages: DataFrame) -> DataFrame:
    """Messages whose tool fields do not suit their role."""
    return messages.where("role NOT IN ('system', 'user', 'assistant', 'tool') OR (role = 'tool') <> (tool_call_id IS NOT NULL) OR (role <> 'assistant' AND size(tool_calls) > 0)")
