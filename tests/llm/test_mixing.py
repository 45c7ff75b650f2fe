"""Mixing against a plain loop over the contract, and its edge cases."""

import re

import pytest
from lexiloom.llm import mixing


def reference(rows):
    sizes = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows if s is not None}, key=lambda s: [ord(c) for c in s]) + ([None] if any(s is None for _, _, s in rows) else [])
    total = {s: sum(n for n, r in zip(sizes, rows) if r[2] == s) for s in names}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes)
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 2 * total[s] + 1e-9}
        if not over:
            target |= {s: left * weight[s] / w for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    return sizes, total, target


def rows_with(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


CASES = {
    "skewed": [(i, "w " * (1 + i % 7), "big" if i % 3 else f"s{i % 11}") for i in range(300)],
    "tiny_heavy": [(1, "a", "a"), (2, "b c", "b"), *[(i, "x " * 50, "c") for i in range(3, 40)]],
    "nulls": [(None, None, None), (1, "", "a"), (2, "a b\tc\x0bd", None), (2, "a b\tc\x0bd", None), (3, "x", "ä"), (4, "y z", "z")],
}


@pytest.mark.parametrize("name", CASES)
def test_targets_and_taken(spark, name):
    rows = CASES[name]
    sizes, total, target = reference(rows)
    got = mixing.mix(rows_with(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted(r["size"] for r in got) == sorted(sizes)
    by_target = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_target.setdefault((r["source_size"], round(r["target"], 6)), []).append(r["taken"])
    want = {}
    for s in total:
        key = (total[s], round(target[s], 6))
        want[key] = want.get(key, 0) + round(target[s])
    assert {k: sum(v) for k, v in by_target.items()} == pytest.approx(want, abs=len(total))


def test_mixed_rows_repeat_and_come_in_order(spark):
    rows = CASES["skewed"]
    docs = rows_with(spark, rows).selectExpr("*", "1 AS taken", "'x' AS __key")
    out = mixing.mixed(docs).collect()
    turns = {r["doc_id"]: r for r in mixing.mix(rows_with(spark, rows)).collect()}
    count = {}
    for r in out:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
        assert r["taken"] == 1
    for d, r in turns.items():
        assert count.get(d, 0) == -(-r["taken"] // r["size"])
    positions = [turns[r["doc_id"]]["first_position"] for r in out if count[r["doc_id"]] == 1]
    assert positions == sorted(positions)


def test_reruns_agree_and_empty(spark):
    docs = rows_with(spark, CASES["skewed"])
    assert sorted(mixing.mix(docs).collect()) == sorted(mixing.mix(docs.repartition(7)).collect())
    assert mixing.mix(rows_with(spark, [])).collect() == []


def test_no_python_in_the_plan(spark):
    plan = mixing.mix(rows_with(spark, CASES["skewed"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
