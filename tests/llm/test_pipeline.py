"""The pipeline, each stage against brute force on its own input."""

import collections
import re

import corpus_pipeline
from conftest import SMALL
from lexiloom.llm import language_id, piece_dropout
from tests.llm.test_operators import ODD, SCHEMA, brute_components


def test_stages_on_their_inputs(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, outs, seen = docs.columns, {}, docs
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, seen, SMALL).write.parquet(path)
        outs[name] = spark.read.parquet(path)
        seen = outs[name]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert seen.columns == columns
    first = {r["doc_id"]: r["text"] for r in docs.collect()}
    langs, scores = language_id.classify(list(first.values()), language_id.train(docs))
    want = {d for d, lang, s in zip(first, langs, scores) if lang != "und" and s >= language_id.MIN_SCORE}
    known = {r["doc_id"]: r["text"] for r in outs["language_id"].collect()}
    assert set(known) == want and len(want) > 190
    groups = collections.defaultdict(list)
    for d, t in known.items():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(d)
    unique = {r["doc_id"]: r["text"] for r in outs["exact_dedup"].collect()}
    assert set(unique) == {min(g) for g in groups.values()}
    near = {r["doc_id"]: r["text"] for r in outs["near_dedup"].collect()}
    assert set(near) == {d for d, _, _, kept in brute_components(sorted(unique.items()), 5, 80) if kept}
    mixed = [r["doc_id"] for r in outs["mixing"].collect()]
    assert set(mixed) <= set(near) and max(collections.Counter(mixed).values()) == 2
    tokens = outs["piece_dropout"].collect()
    assert sorted(r["doc_id"] for r in tokens) == sorted(mixed)
    assert all(piece_dropout.decode_ids(r["ids"], piece_dropout.default_path()) == first[r["doc_id"]] for r in tokens)


def test_run_agrees_with_itself(spark):
    a, b = ([(r["doc_id"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SMALL).collect()] for _ in range(2))
    assert sorted(a) == sorted(b) and len(a) > 0


def test_odd_and_empty_inputs(spark):
    for rows in (ODD, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            got = out.collect()
            assert name == "piece_dropout" or out.columns == docs.columns
            assert rows or not got


def test_columns_with_the_stages_own_names(spark):
    """Extra columns whose names the stages use inside: every stage keeps them and their values."""
    names = ["__lx_text", "__lx_keep", "__lx_id", "__lx_mark", "__lx_n", "__row", "__position", "__turn", "__salt", "id", "mark", "key", "node", "digest", "taken", "size", "text_hash", "group", "nth", "n"]
    texts = ["the cat sat on the mat and slept all day long in the sun", "der hund lief durch den wald und kam nicht mehr nach haus", "le chat dort sur le lit et ne veut pas sortir ce matin"]
    rows = [(i, texts[i % 3] + f" number {i}", ["en", "de", "fr"][i % 3], "ab"[i % 2], i, *[f"{c}{i}" for c in names]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        got = out.collect()
        assert out.columns == docs.columns and got, name
        assert all(r[c] == f"{c}{r['doc_id']}" for r in got for c in names), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == 30
