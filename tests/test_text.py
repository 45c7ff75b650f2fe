"""Text kernels against plain Python over arbitrary Unicode."""

import re
import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from lexiloom.functions import envelope
from lexiloom.functions import text as T
from pyspark.sql import functions as F

CONTROL = re.compile("[\x00-\x1f\x7f-\x9f​-‏ - ﻿]")
TEXT = st.text(st.one_of(st.sampled_from(" \t\r\n\x85\xa0\x1c​﻿ .!?ab"), st.characters(blacklist_categories=("Cs",))), max_size=40)


def plain_paragraphs(text):
    return [p.strip() for p in re.split(r"[\r\n]+", text) if CONTROL.sub("", p.strip()).strip()]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(TEXT, min_size=30, max_size=30))
def test_kernels_equal_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = df.select("i", "text", T.paragraphs(F.col("text")).alias("paras"), T.strip(F.col("text")).alias("strip"), T.clean_for_prompt(F.col("text")).alias("keep"), T.clean_for_prompt(F.col("text"), False).alias("fold"), T.is_blank(F.col("text")).alias("blank")).collect()
    for r in got:
        t = r["text"]
        assert r["strip"] == t.strip()
        assert r["paras"] == plain_paragraphs(t)
        assert r["keep"] == envelope.clean(t) and r["fold"] == envelope.clean(t, False)
        assert envelope.clean(r["keep"]) == r["keep"] and envelope.clean(r["fold"], False) == r["fold"]
        assert r["blank"] == (not CONTROL.sub("", t).strip())


def test_reply_expressions(spark):
    cases = {
        "<think>x</think> [1]": "[1]", "[1]": "[1]", "<think>a</think>": None, "  ": None, "<think>open [1]": "<think>open [1]", "a <think>b</think>": "a <think>b</think>",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", T.without_thinking(F.col("t")).alias("x")).collect()} == cases
    valid = {"[1]": True, "{}": True, "```json\n[1]\n```": True, "42": False, '"a"': False, "[1]]": False, "[1]}": False, "[1],[2]": False, '[1],"y":2': False, "": False, "nope": False}
    df = spark.createDataFrame([(k,) for k in valid], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", T.parsed_json(F.col("t")).isNotNull().alias("x")).collect()} == valid
    assert {k: envelope.parse(k) is not None for k in valid} == valid


def test_ids_dates_fields_markdown(spark):
    row = spark.range(1).select(
        T.structural_index(F.lit("P12-S3"), "S").alias("a"), T.structural_index(F.lit("C7"), "C").alias("b"), T.structural_index(F.lit("A"), "A").alias("c"),
        T.strict_date(F.lit(" 1-2-2024 ")).cast("string").alias("d"), T.strict_date(F.lit("2024-02-01")).alias("e"), T.strict_date(F.lit("31-02-2024")).alias("f"),
        T.metadata_field(F.lit("Style: Normal, Comment ID: 3, Author: A B"), "Author").alias("g"),
        T.without_markdown(F.lit("**b** *i* ~~s~~ [t](http://u) <u>x</u>")).alias("h"),
    ).first()
    assert tuple(row) == (3, 7, None, "2024-02-01", None, None, "A B", "b i s t x")


def test_spaces_are_pythons(spark):
    chars = [chr(c) for c in range(1, 0x3100) if unicodedata.category(chr(c)) != "Cs"]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    got = {r["c"] for r in df.where(F.length(T.strip(F.col("c"))) == 0).collect()}
    assert got == {c for c in chars if c.isspace()}


def test_all_character_references_are_decoded(spark):
    import html as library

    from lexiloom.sources import html

    said = "caf&eacute; &mdash; &#233;&#x2019;s &amp;lt; &copy; &hellip; &notanything; a & b"
    pages = spark.createDataFrame([(1, f"<body><h2>{said}</h2><p>{said}&nbsp;x</p></body>"), (2, None)], "page_id long, html string")
    text = {r["doc_id"]: r["text"] for r in html.documents(pages).collect()}
    assert text[2] is None and [t for t in text[1].split("\n") if t] == [library.unescape(said), library.unescape(said) + " x"]
    assert [r["md"] for r in html.headings(pages).collect()] == ["## " + library.unescape(said)]
