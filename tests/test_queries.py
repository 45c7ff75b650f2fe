"""Every registered query of the engine against DuckDB over the same tables."""

import subprocess
import sys

import __spark_entry__ as entry
import oracle
import pytest
from conftest import ROOT, SMALL
from lexiloom import queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, name):
    oracle.assert_same(queries.queries()[name](spark, SMALL), queries.oracle_sql()[name], SMALL)


def test_entry_has_rows_and_names_agree(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_known_totals(spark):
    from conftest import MEDIUM

    rows = queries.queries()["paragraphs_split"](spark, MEDIUM).collect()
    assert (len(rows), sum(len(r["raw_text"]) for r in rows)) == (9344, 2_401_526)
    assert queries.queries()["sentences_split"](spark, MEDIUM).count() == 37_975


def test_engine_stands_without_the_corpus_operators(tmp_path):
    """Without the llm folders and the pipeline the entry module imports and keeps the other queries."""
    import shutil

    shutil.copytree(ROOT / "lexiloom", tmp_path / "lexiloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'extract_all_items' in q and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) == set(q); print('ok')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.strip() == "ok", out.stderr[-500:]


ODD = ("cut &amp", "x&amp y &copy z", "&#39 &ampx; &amp;lt; &ampnbsp; &&&amp;&quo", "\u3000wide\u00a0", "\tkept &nbsp;", f"&#{'9' * 5000};")


def odd_pages(spark, folder, rows):
    spark.createDataFrame([*enumerate(rows), (len(rows), None)], "page_id long, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def test_headings_are_those_of_the_sql_on_odd_pages(spark, tmp_path):
    name, at = "html_headings_md", odd_pages(spark, tmp_path, [*(f"<h2>{t}</h2>" for t in ODD), "<h1é>a</h1><h3_>b</h3>"])
    assert oracle.assert_same(queries.queries()[name](spark, at), queries.oracle_sql()[name], at) == len(ODD) + 1


def test_page_paragraphs_are_those_of_the_sql_on_odd_pages(spark, tmp_path):
    name, at = "html_to_paragraphs", odd_pages(spark, tmp_path, [*(f"<p>{t}</p><li>{t}" for t in ODD), "a<lié>b<pre_>c<br/>d", "<style>x</style\x0b>y<scripté>z</script\t>e"])
    assert oracle.assert_same(queries.queries()[name](spark, at), queries.oracle_sql()[name], at) == 2 * len(ODD) + 4
