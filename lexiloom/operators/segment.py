"""Documents to paragraphs, sentences and chunks. All narrow: arrays are built in the document's row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as T


def with_paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and a column paras: array of paragraph texts."""
    return docs.withColumn("paras", F.coalesce(T.paragraphs(F.col(text)), F.array().cast("array<string>")))


def unrolled(frame: DataFrame, keep: list[str], values: Column, index: str, name: str) -> DataFrame:
    """One row per element. The outer form, with its empty rows taken out again: the plain
    one makes Catalyst add a filter that works out the whole array a second time."""
    return frame.select(*keep, F.posexplode_outer(values).alias(index, name)).where(F.col(index).isNotNull())


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, para_idx, raw_text), indices from 0."""
    return unrolled(docs, ["doc_id"], T.paragraphs(F.col(text)), "para_idx", "raw_text")


def sentences(docs: DataFrame, text: str = "text", split=T.sentences) -> DataFrame:
    """(doc_id, para_idx, sent_idx, raw_text). ``split``: a paragraph's Column to an array of sentences."""
    paras = paragraphs(docs, text).withColumnRenamed("raw_text", "para")
    return unrolled(paras, ["doc_id", "para_idx"], split(F.col("para")), "sent_idx", "raw_text")


def trained_splitter(make):
    """A ``split`` from a trained segmenter: ``make()``, called once a worker, gives ``texts -> a list of sentences each``.

    For models in a local folder let ``make`` load them. Sentences are stripped, blank ones go; a sentence that is not in its
    paragraph is an error, as references would point nowhere.
    """
    held: dict = {}

    def cut(paras: list) -> list:
        if "model" not in held:
            held["model"] = make()
        out = []
        for para, found in zip(paras, held["model"]([p or "" for p in paras])):
            out.append([s.strip() for s in found if s.strip()])
            if any(s not in (para or "") for s in out[-1]):
                raise ValueError("the segmenter gave a sentence that its paragraph does not hold")
        return out

    def one(paras: pd.Series) -> pd.Series:
        return pd.Series(cut(list(paras)))

    def many(rows: pd.Series) -> pd.Series:
        flat = cut([p for row in rows for p in row])
        ends = pd.Series([len(row) for row in rows], dtype="int64").cumsum().tolist()
        return pd.Series([flat[e - len(row) : e] for e, row in zip(ends, rows)])

    def split(paragraph: Column) -> Column:
        return F.pandas_udf(one, "array<string>")(paragraph)

    #: The same for an array of paragraphs, as Python functions cannot stand within ``transform``.
    split.of_array = lambda paras: F.pandas_udf(many, "array<array<string>>")(paras)
    return split


def rebuilt(paras: DataFrame) -> DataFrame:
    """(doc_id, raw_text): a document's paragraphs joined by an empty line."""
    listed = F.array_sort(F.collect_list(F.struct("para_idx", "raw_text")))
    return paras.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda x: x["raw_text"]), "\n\n").alias("raw_text"))


def from_paragraphs(docs: DataFrame, paras: str = "paras") -> DataFrame:
    """A document given as an array of paragraphs: raw_text is their join. Narrow, unlike ``rebuilt``."""
    return docs.withColumn("raw_text", F.array_join(paras, "\n\n"))


def chunk_of(index: Column, size: int) -> Column:
    """Chunk number of a 0-based index; size 0 is one chunk."""
    return F.floor(index / size).cast("int") if size else F.lit(0)


def chunks(paras: DataFrame, size: int) -> DataFrame:
    """Paragraphs with text_chunk and their position within it (P-ids are chunk-relative)."""
    pos = F.col("para_idx") - F.col("text_chunk") * F.lit(size)
    return paras.withColumn("text_chunk", chunk_of(F.col("para_idx"), size)).withColumn("pos", pos.cast("int"))


def sliced(values: Column, size: int) -> Column:
    """An array cut into arrays of at most ``size``, in order (no shuffle)."""
    if not size:
        return F.array(values)
    last = F.greatest(F.floor((F.size(values) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(values, i * size + 1, F.lit(size)))


def chunk_sizes(docs: DataFrame, size: int, text: str = "text") -> DataFrame:
    """(doc_id, text_chunk, n, last_pos, n_chars) of each document's chunks, within the document's row."""
    cut = unrolled(with_paragraphs(docs.select("doc_id", text), text), ["doc_id"], sliced(F.col("paras"), size), "text_chunk", "chunk").where("size(chunk) > 0")
    chars = F.aggregate("chunk", F.lit(0).cast("long"), lambda n, p: n + F.length(p))
    return cut.select("doc_id", "text_chunk", F.size("chunk").cast("long").alias("n"), (F.size("chunk") - 1).cast("long").alias("last_pos"), chars.alias("n_chars"))


def position_of_paragraph(paras: DataFrame, wanted: DataFrame) -> DataFrame:
    """Positions of (doc_id, raw_text) pairs: every index at which the text stands."""
    return wanted.join(paras, ["doc_id", "raw_text"]).select("doc_id", "raw_text", "para_idx")


def position_of_sentence(sents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Positions of (doc_id, raw_text) pairs among sentences: every (para_idx, sent_idx) at which the text stands."""
    return wanted.join(sents, ["doc_id", "raw_text"]).select("doc_id", "raw_text", "para_idx", "sent_idx")


def order_check(docs: DataFrame, paras: str = "paras", text: str = "text") -> DataFrame:
    """``docs`` and in_order: each paragraph occurs behind the end of the one before it."""
    start = F.struct(F.lit(1).alias("at"), F.lit(True).alias("ok"))

    def step(state, p):
        found = F.call_function("locate", p, F.col(text), state["at"])
        return F.struct((found + F.length(p)).cast("int").alias("at"), (state["ok"] & (found > 0)).alias("ok"))

    return docs.withColumn("in_order", F.aggregate(F.col(paras), start, step, lambda s: s["ok"]))


def with_repeats(paras: DataFrame) -> DataFrame:
    """Paragraphs and times, how often their text stands in their document; one shuffle."""
    same = Window.partitionBy("doc_id", "raw_text")
    return paras.withColumn("times", F.count(F.lit(1)).over(same))


def repeated(paras: DataFrame) -> DataFrame:
    """(doc_id, raw_text, n, first_idx, last_idx) of paragraph texts that stand more than once in a document."""
    found = paras.groupBy("doc_id", "raw_text").agg(F.count(F.lit(1)).alias("n"), F.min("para_idx").alias("first_idx"), F.max("para_idx").alias("last_idx"))
    return found.where("n > 1")


def renumbered(paras: DataFrame, by: str = "para_idx") -> DataFrame:
    """Sub-document: kept paragraphs numbered anew in their order."""
    order = Window.partitionBy("doc_id").orderBy(by)
    return paras.withColumn("sub_idx", F.row_number().over(order) - 1)
