"""Operators that SQL cannot express, against plain programs that share no code with them, and what their files hold."""

import glob
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import SMALL
from lexiloom.llm import language_id, mixing, near_dedup, piece_dropout, token_orc
from lexiloom.llm.common import Scratch, shared_dir
from lexiloom.llm.components import components

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

# ---- 1


def plain_score(text: str, net) -> tuple[str, float]:
    """The network's answer for one text, window by window, filter by filter, place by place."""
    raw = text.encode()
    total = np.zeros(len(net.classes))
    for begin in range(0, len(raw), 256):
        held = raw[begin : begin + 256]
        window = held + bytes(256 - len(held))
        letters = [net.p["embed"][b].astype(float) for b in window]
        pooled = []
        for f in range(48):
            width = (2, 3, 4)[f // 16]
            best = max(sum(float(letters[at + j] @ net.p["conv"][8 * j : 8 * j + 8, f]) for j in range(width)) for at in range(256 - 4 + 1))
            pooled.append(max(0.0, best + float(net.p["bias"][f])))
        z = np.array(pooled) @ net.p["out"] + net.p["base"]
        e = np.exp(z - z.max())
        total += e / e.sum() * len(held)
    mean = total / len(raw)
    return net.classes[int(mean.argmax())], float(mean.max())


def test_language_scores_by_plain_loops(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    net = language_id.train(docs)
    texts = [r["text"][:900] for r in docs.orderBy("doc_id").limit(4).collect()] + ["a", "Straße!"]
    langs, scores = language_id.classify(texts, net)
    for text, lang, score in zip(texts, langs, scores):
        want, value = plain_score(text, net)
        assert (lang, score) == (want, pytest.approx(value, abs=2e-4))


def test_language_sample_is_bounded_under_repeats(spark):
    rows = [(7, "the same words again", "en")] * 3000 + [(7, f"other words number {i}", "en") for i in range(3000)] + [(8, "encore des mots", "fr")] * 3000
    x, y, classes = language_id.training_windows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 100, 6)
    assert classes == ["en", "fr"] and len(x) < 300 and len(x) == len(y)


# ---- 2


def test_links_of_a_block_by_plain_sets():
    """The links connect what the plain check of all pairs connects, and no more of them come out than components go."""
    rng = random.Random(5)
    for _ in range(30):
        n, percent = rng.randint(2, 40), 60
        sets = [sorted(rng.sample(range(30), rng.randint(1, 14))) for _ in range(n)]
        sets += [sorted(set(s[:-1]) or set(s)) for s in sets[: n // 2]]
        root = np.array([rng.randrange(1, 12) * 100 for _ in sets])
        pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if root[i] != root[j]]
        rng.shuffle(pairs)
        i, j = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
        held = near_dedup.Sets([np.array(s, np.uint64).tobytes() for s in sets])
        got = near_dedup.linked_roots(i, j, np.array([rng.randrange(9) for _ in pairs], np.int64), root, held, percent) if pairs else []

        def closed(links):
            name = {int(r): int(r) for r in root}
            for a, b in links:
                old, new = name[a], name[b]
                name = {k: new if v == old else v for k, v in name.items()}
            return {frozenset(k for k in name if name[k] == v) for v in name.values()}

        want = [(int(root[a]), int(root[b])) for a, b in pairs if 100 * len(set(sets[a]) & set(sets[b])) >= percent * len(set(sets[a]) | set(sets[b]))]
        assert closed(got) == closed(want) and len(got) == len(set(root.tolist())) - len(closed(want))


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(300, 301), (301, 302), (302, 300), (5, 5)]
    links += [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(70)]
    rng.shuffle(links)
    root = {n: n for a, b in links if a != b for n in (a, b)}
    for _ in range(100):
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    for held in (links, links[:1], [(9, 3)], [(4, 4)], []):
        want = root if held is links else {n: min(x) for x in held if x[0] != x[1] for n in x}
        got = components(spark.createDataFrame(held, "a long, b long"), Scratch(spark, "test")).collect()
        assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)


# ---- 4


def orc_reader(spark, path):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.orc.OrcFile.createReader(at, jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration()))


@pytest.fixture(scope="module")
def orc_path(spark):
    docs = spark.range(24_000).selectExpr("id * 3 AS doc_id", "concat('word ', id, ' and some more words of text ', id * 7) AS text")
    out = shared_dir(spark, "orc-inside")
    token_orc.write_orc(token_orc.encode(token_orc.in_order(docs.repartition(3)).coalesce(1), BPE), out, 64 << 10)
    return out


def test_orc_files_hold_stripes_run_lengths_indexes_and_bloom_filters(spark, orc_path):
    (path,) = glob.glob(f"{orc_path.removeprefix('file:')}/part-*.orc")
    reader = orc_reader(spark, path)
    stripes = reader.getStripes()
    assert stripes.size() > 2 and reader.getRowIndexStride() == 1000 and reader.getNumberOfRows() == 24_000
    rows = reader.rows()
    for n in range(stripes.size()):
        foot = rows.readStripeFooter(stripes.get(n))
        streams = {(s.getKind().toString(), s.getColumn()) for s in foot.getStreamsList()}
        assert {("BLOOM_FILTER_UTF8", 1), ("ROW_INDEX", 1), ("ROW_INDEX", 3), ("LENGTH", 3), ("DATA", 4)} <= streams
        assert [foot.getColumns(i).getKind().toString() for i in (1, 2, 3, 4)] == ["DIRECT_V2"] * 4


def rows_read(frame) -> int:
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_orc_reader_skips_row_groups(spark, orc_path):
    assert rows_read(token_orc.lookup(spark, orc_path, [3 * 5000])) <= 2000  # by statistics
    absent = [rows_read(token_orc.lookup(spark, orc_path, [3 * i + 1])) for i in (700, 5200, 9900, 14_100, 21_000)]
    assert sum(absent) <= 2000 and 0 in absent  # within the range of a row group: by Bloom filter
    assert token_orc.lookup(spark, orc_path, [3 * i for i in (0, 11_111, 23_999)]).count() == 3


def test_stripes_are_read_in_parallel(spark, orc_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        got = spark.read.orc(orc_path)
        parts = [r["n"] for r in got.selectExpr("spark_partition_id() AS p").groupBy("p").count().withColumnRenamed("count", "n").collect()]
        assert len(parts) > 1 and sum(parts) == 24_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_ranges_by_binary_search(spark):
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 7, 8, 100):
        bounds = sorted(rng.sample(range(1000), n))
        rows = spark.createDataFrame([(i,) for i in range(-2, 1003)] + [(None,)], "doc_id long")
        got = rows.withColumn("at", token_orc.range_of("doc_id", bounds)).collect()
        assert all(r["at"] == (0 if r["doc_id"] is None else sum(b <= r["doc_id"] for b in bounds)) for r in got)
    assert token_orc.file_count(10**9, 10**14, 200) > 300_000 and token_orc.file_count(10, 2**62, 200) == 1 and token_orc.file_count(0, 0, 8) == 1


def test_hot_ids_are_cut_over_files(spark):
    """A doc_id with a third of all rows, and rows without one: several files, in order, with the right starts."""
    before, token_orc.ROWS_PER_FILE = token_orc.ROWS_PER_FILE, 50
    try:
        rows = [(500, f"hot {i}") for i in range(300)] + [(None, f"none {i}") for i in range(200)] + [(i, f"text {i}") for i in range(0, 1000, 3)]
        random.Random(1).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        placed = token_orc.in_order(docs).selectExpr("spark_partition_id() AS p", "doc_id", "text").collect()
        sizes = [sum(r["p"] == p for r in placed) for p in {r["p"] for r in placed}]
        assert len(placed) == len(rows) and max(sizes) < 150, sizes
        order = [(r["p"], -1 if r["doc_id"] is None else r["doc_id"]) for r in placed]
        assert [d for _, d in sorted(order)] == sorted(d for _, d in order)
        out = shared_dir(spark, "orc-hot")
        token_orc.token_files(docs, BPE, out)
        got = sorted((r["start"], r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]) for r in token_orc.read_index(spark, out).collect())
        assert len(got) == len(rows) and [d for *_, d in got] == sorted(d for *_, d in got)
        assert all(a[0] + a[1] == b[0] for a, b in zip(got, got[1:]))
    finally:
        token_orc.ROWS_PER_FILE = before
        spark.conf.set("spark.sql.shuffle.partitions", "4")


# ---- 8

M64 = (1 << 64) - 1
A, B, C = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15


def scramble(x: int) -> int:
    for factor in (A, B):
        x = (x ^ x >> 33) * factor & M64
    return x ^ x >> 33


def plain_pieces(text: str, doc_id: int, dropout: float, seed: int) -> list[int]:
    """Merge-dropout as described: words in turn, always the best pair left, skipped for good where its hash says so."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    plain = {sp.id_to_piece(i).replace("▁", " "): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    order = {i: r for r, i in enumerate(sorted(plain.values(), key=lambda i: (-sp.get_score(i), i)))}
    kind = lambda c: "space" if c == " " else "letter" if re.fullmatch("[A-Za-zÀ-ÖØ-öø-ɏ]", c) else "other"
    words: list[str] = []
    for c in " " + text if text else "":
        if words and (kind(words[-1][-1]) in ("space", kind(c))):
            words[-1] += c
        else:
            words.append(c)
    out: list[int] = []
    for nth, word in enumerate(words):
        turn = scramble((scramble((doc_id + seed) & M64) + nth * C) & M64)
        key = scramble((xxhash.xxh64_intdigest(word.encode(), seed) + turn * C) & M64)
        parts = [(i, c) for i, c in enumerate(word)]
        skipped: set = set()
        while True:
            found = [(order[plain[a + b]], i, a + b) for (i, a), (_, b) in zip(parts, parts[1:]) if a in plain and b in plain and a + b in plain and (i, len(a), a + b) not in skipped]
            if not found:
                break
            _, at, made = min(found)
            n = next(k for k, (i, _) in enumerate(parts) if i == at)
            if scramble(key ^ (at * C + plain[made] * B & M64)) >> 11 < int(dropout * (1 << 53)):
                skipped.add((at, len(parts[n][1]), made))
            else:
                parts[n : n + 2] = [(at, made)]
        for _, part in parts:
            out += [plain[part]] if part in plain else [next(i for i in range(sp.get_piece_size()) if sp.is_byte(i) and int(sp.id_to_piece(i)[3:5], 16) == b) for b in part.encode()]
    return out


def test_dropout_against_a_plain_program():
    texts = ["information and transformation", "  The  unbelievable\nstory, 1234 of ▁x é日", "", "a", "ab " * 20, "counterrevolutionaries' uncharacteristically"]
    for dropout in (0.0, 0.1, 0.5):
        ids, sizes = piece_dropout.Segmenter(PIECES, dropout, 99)(texts, np.array([3, 4, 5, 6, 7, 1 << 40], np.uint64))
        ends = np.cumsum(sizes)
        for text, doc, a, n in zip(texts, (3, 4, 5, 6, 7, 1 << 40), ends - sizes, sizes):
            assert ids[a : a + n].tolist() == plain_pieces(text, doc, dropout, 99), (text, dropout)


# ---- 9


def test_mix_of_tied_rows_repeats(spark):
    """Rows with one doc_id, or none, and texts of one size: reruns on other partitions give the same order, and no bucket holds them all."""
    rows = [(None if i % 2 else 5, f"w{i} x y", "a" if i % 5 else "b", i) for i in range(400)] + [(9, "same text", "a", i) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    one, two = ([tuple(r) for r in mixing.mixed(d).collect()] for d in (docs, docs.repartition(5, "n_chars")))
    assert one == two and len(one) > 400
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(3)).collect()), key=str)
    assert mixing.buckets_for(10**10) <= 10**5 and mixing.buckets_for(0) == 1 and mixing.buckets_for(1000) == 2


def test_held_out_rows_are_those_of_the_contract(spark):
    got = spark.range(1000).selectExpr("id AS doc_id").select("doc_id", language_id.held_out().alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
