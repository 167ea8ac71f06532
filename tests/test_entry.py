import ast
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WITH_SQL = sorted(entry.oracle_sql())


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", WITH_SQL)
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=str)


def test_flagship(spark):
    assert {r["score_eval"] for r in entry.entry(spark).select("score_eval").distinct().collect()} <= {"TP", "FP", "FN", "TN"}


def test_nothing_else_imports_llm():
    for source in (ROOT / "termweave").rglob("*.py"):
        if "llm" in source.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(source.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), source


def test_block_documents_keeps_frequent_tokens(spark, tmp_path):
    rows = [(i, f"shared a{chr(97 + i // 26)}{chr(97 + i % 26)} of it", "en") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(i, f"shared z{chr(97 + i)}") for i in range(5)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert entry.queries()["block_documents"](spark, str(tmp_path)).count() == 5 * 40
