"""The outputs of a run: all of them or none, with their types and counts."""

import pytest
from pyspark.sql import functions as F

from termweave.sources.runs import read_manifest, read_run, write_run


def test_outputs_come_back(spark, tmp_path):
    a = spark.createDataFrame([(1, 'x, "y"\nz', ["p", "q"], True, 0.5), (2, None, [], None, None), (3, "", None, False, -1.0)], "id long, text string, list array<string>, ok boolean, p double")
    b = spark.createDataFrame([(i, "odd" if i % 2 else "even") for i in range(7)], "id long, kind string")
    folder = str(tmp_path / "run")
    write_run({"a": a, "b": b, "none": b.limit(0)}, folder, {"b": ["kind"]})
    assert {(r.name, r.rows) for r in read_manifest(spark, folder).collect()} == {("a", 3), ("b", 7), ("none", 0)}
    got = read_run(spark, folder, "a")
    assert dict(got.dtypes) == {"id": "bigint", "text": "string", "list": "string", "ok": "boolean", "p": "double"}
    assert sorted(tuple(r) for r in got.where("id <> 1").collect()) == [(2, None, "[]", None, None), (3, "", None, False, -1.0)]
    assert sorted((r.id, r.kind) for r in read_run(spark, folder, "b").collect()) == sorted((r.id, r.kind) for r in b.collect())
    assert (tmp_path / "run" / "b" / "kind=odd").is_dir() and read_run(spark, folder, "none").count() == 0


def test_a_failed_run_is_not_there(spark, tmp_path):
    good = spark.range(3)
    folder = str(tmp_path / "run")
    write_run({"a": good}, folder)
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("string").alias("x"))
    with pytest.raises(Exception, match="no"):
        write_run({"a": good, "b": bad}, folder)
    with pytest.raises(Exception):  # noqa: B017
        read_run(spark, folder, "a")
    write_run({"a": good}, folder)
    spark.range(2).write.mode("append").option("header", True).csv(f"{folder}/a")
    with pytest.raises(ValueError, match="has 5 rows, the manifest says 3"):
        read_run(spark, folder, "a")
    with pytest.raises(ValueError, match="no output c"):
        read_run(spark, folder, "c")
