"""Sessions: the package on the executors' path, and the folder that all share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()

#: Rows of an Arrow batch to and from Python. Rows hold whole texts, and a task has a batch of them
#: on both sides; Spark's own value stands for small rows.
BATCH_SETTING, SPARKS_ROWS, ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def ship_package(spark: SparkSession) -> None:
    """Hand this package's sources to the executors of a session, once (as spark-submit --py-files).

    Where the session leaves the rows of an Arrow batch at Spark's value, they become ROWS.
    """
    context = spark.sparkContext
    if spark.conf.get(BATCH_SETTING) == SPARKS_ROWS:
        spark.conf.set(BATCH_SETTING, ROWS)
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix=f"{root.name}-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(root.rglob("*.py")):
            archive.write(source, source.relative_to(root.parent))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only where the session names none, as in local tests, a temporary one is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    have = spark.sparkContext.getCheckpointDir()
    if have is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="termweave-"))
        have = spark.sparkContext.getCheckpointDir()
    return have


#: Whether Spark removes a query's shuffle files at its end, not when the driver next collects garbage.
TIDY_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tidy: bool = False) -> DataFrame:
    """df as a compressed table in the shared folder; for wide rows, smaller than a checkpoint.

    With ``tidy``, the shuffle files of the write are removed at its end.
    """
    conf, path = df.sparkSession.conf, f"{shared_dir(df.sparkSession)}/termweave-{uuid.uuid4().hex}"
    before = conf.get(TIDY_SETTING, None)
    if tidy:
        conf.set(TIDY_SETTING, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidy and before is None:
            conf.unset(TIDY_SETTING)
        elif tidy:
            conf.set(TIDY_SETTING, before)
    return df.sparkSession.read.parquet(path)


#: So many words at most are sent to every task.
FEW_TOKENS = 1_000_000


def few(words: DataFrame) -> DataFrame:
    """words, to be broadcast if they are few."""
    return F.broadcast(words) if words.count() <= FEW_TOKENS else words
