"""The outputs of a matching run: five tables in one folder, which exist for readers all or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .catalog import flattened

MANIFEST = "_manifest"
#: Null and empty texts differ, and a text may hold quotes and line ends.
TEXT = {"header": True, "nullValue": "\\N", "escape": '"', "multiLine": True}


def write_run(outputs: dict[str, DataFrame], folder: str, partition_by: dict[str, list[str]] | None = None) -> None:
    """Write every output (name -> table) as CSV below folder, and then the manifest: name, rows, schema.

    Arrays and structs become JSON text. partition_by names the columns by whose values an output's
    files are parted. The manifest is written last, so a run that fails leaves nothing that read_run
    takes; writing to a folder again takes the old manifest away first. Rows are counted as they are
    written, without another pass. Column names must differ from one another.
    """
    spark = next(iter(outputs.values())).sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{MANIFEST}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    lines = []
    for name, df in outputs.items():
        flat, seen = flattened(df), Observation()
        counted = flat.observe(seen, F.count(F.lit(1)).alias("rows"))
        writer = counted.write.mode("overwrite").options(**TEXT)
        parts = (partition_by or {}).get(name, [])
        (writer.partitionBy(*parts) if parts else writer).csv(f"{folder}/{name}")
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema.fields)
        lines.append((name, seen.get["rows"], schema))
    spark.createDataFrame(lines, "name string, rows long, schema string").coalesce(1).write.json(f"{folder}/{MANIFEST}")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(name, rows, schema) of a whole run; an error where there is none."""
    return spark.read.schema("name string, rows long, schema string").json(f"{folder}/{MANIFEST}")


def read_run(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """An output of a run with the types that it was written with; its rows must be as many as the
    manifest says."""
    entry = read_manifest(spark, folder).where(F.col("name") == name).first()
    if entry is None:
        raise ValueError(f"{folder} has no output {name}")
    df = spark.read.schema(entry["schema"]).options(**TEXT).csv(f"{folder}/{name}")
    if (rows := df.count()) != entry["rows"]:
        raise ValueError(f"{folder}/{name} has {rows} rows, the manifest says {entry['rows']}")
    return df


def run_outputs(candidates: DataFrame, found: DataFrame, labels: DataFrame, gold: DataFrame, names: DataFrame) -> dict[str, DataFrame]:
    """The five outputs of a run.

    candidates has (name_id, name, term_id, term, ...); found the same with match and the features, before
    labels are applied; labels (name_id, term_id, label); gold (name, term); names the names with their
    derived strings. blocking is the candidates; training_labels the labelled pairs with what the
    forest said of them; matches all pairs with the labels in its place; score_eval these and the gold
    pairs, judged; names the names as the next epoch takes them.
    """
    from ..operators.evaluate import apply_labels, score_eval

    matches = apply_labels(found, labels)
    return {
        "blocking": candidates, "training_labels": found.join(labels, ["name_id", "term_id"]), "matches": matches,
        "score_eval": score_eval(matches, gold), "names": names,
    }
