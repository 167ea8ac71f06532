"""A training-data pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.llm.best_fit_packing import best_fit_packing
from termweave.llm.common import may_be_in, written
from termweave.llm.decontaminate import decontaminate
from termweave.llm.language_id import identify_language
from termweave.llm.simhash_dedup import simhash_components
from termweave.llm.substring_dedup import substring_dedup
from termweave.session import ship_package


def _neutral(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns c0, c1 ... (no operator's output has such a name), and name -> new name."""
    names = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _restored(df: DataFrame, names: dict[str, str], **changed) -> DataFrame:
    return df.select(*[changed.get(name, F.col(new)).alias(name) for name, new in names.items()])


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts and texts without a letter) go; a null lang is filled in."""
    ship_package(spark)
    rows, names = _neutral(docs)
    doc_id, text, lang = names["doc_id"], names["text"], names["lang"]
    carry = tuple(c for c in rows.columns if c != doc_id)
    found = identify_language(rows, doc_id, text, lang, carry=carry)
    kept = found.where("lang_pred is null or lang_pred <> 'und'")
    return _restored(kept, names, lang=F.coalesce(F.col(lang), F.col("lang_pred")))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies (5-word Jaccard >= 0.8) the row with the smallest id stays (of
    several with that id, one); rows with a null id stay. Rows of one id whose texts are in
    different groups are judged each."""
    ship_package(spark)
    rows, names = _neutral(docs)
    rows = rows.withColumn("__doc", F.col(names["doc_id"]).cast("long")).withColumn("__hash", F.xxhash64(names["text"]))
    found = written(simhash_components(rows, names["doc_id"], names["text"], shingle=5, similarity=0.8).where("doc is not null"))
    head = found.where("doc = component")
    several = head.groupBy("grp").agg(F.min("hash").alias("least"), F.count("*").alias("rows")).where("rows > 1")
    heads = head.join(several, "grp").select("doc", "hash", (F.col("hash") == F.col("least")).alias("first"))
    texts = found.where("doc <> component").select("doc", "hash", F.lit(False).alias("first")).unionByName(heads).distinct()
    texts = written(texts.withColumnsRenamed({"doc": "__doc", "hash": "__hash"}))
    # most rows are not among these texts, by a bitmap, and stay without a join
    named = may_be_in(F.col("__hash"), texts, "__hash")
    met = rows.where(named).join(texts, ["__doc", "__hash"], "left").where(F.coalesce("first", F.lit(True)))
    if not texts.where("first").isEmpty():
        again = met.where("first is not null").dropDuplicates(["__doc", "__hash"])
        met = met.where("first is null").unionByName(again)
    return _restored(rows.where(~named).unionByName(met.drop("first")), names)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a smaller document has are cut out; the rest is unchanged."""
    ship_package(spark)
    rows, names = _neutral(docs)
    doc_id, text = names["doc_id"], names["text"]
    cut = substring_dedup(rows, doc_id, text, carry=tuple(c for c in rows.columns if c != doc_id))
    new = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col(text))
    changed = {"text": new}
    if "n_chars" in names:
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col(names["n_chars"]))
    return _restored(cut, names, **changed)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    ship_package(spark)
    rows, names = _neutral(docs)
    doc_id = names["doc_id"]
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate(rows, benchmark, doc_id, names["text"], carry=tuple(c for c in rows.columns if c != doc_id))
    return _restored(found.where("n_hit = 0"), names)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of the documents' tokens and its place in a sequence of 2048."""
    ship_package(spark)
    return best_fit_packing(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: The packing and the learned stage have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, one after another, over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
