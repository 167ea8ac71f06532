"""Labels from gold, overrides and match quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_from_gold(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """pairs with label: whether (name, term) is a gold pair."""
    marked = gold.select("name", "term").distinct().withColumn("_g", F.lit(True))
    return pairs.join(marked, ["name", "term"], "left").withColumn("label", F.col("_g").isNotNull()).drop("_g")


def apply_labels(predictions: DataFrame, labels: DataFrame) -> DataFrame:
    """predictions whose match is the user's label wherever there is one."""
    given = labels.select("name_id", "term_id", F.col("label").alias("_l"))
    joined = predictions.join(given, ["name_id", "term_id"], "left")
    return joined.withColumn("match", F.coalesce("_l", "match")).drop("_l")


def eval_outer(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """(name, term, found, is_gold): a full outer join of distinct pairs."""
    a = pairs.select("name", "term").distinct().withColumn("_a", F.lit(True))
    b = gold.select("name", "term").distinct().withColumn("_b", F.lit(True))
    return a.join(b, ["name", "term"], "full").select(
        "name", "term", F.col("_a").isNotNull().alias("found"), F.col("_b").isNotNull().alias("is_gold")
    )


def precision_recall(pairs: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall and f1 in percent (null where undefined)."""
    both = eval_outer(pairs, gold)
    count = lambda c: F.coalesce(F.sum(F.expr(f"int({c})")), F.lit(0))
    sums = both.agg(count("found and is_gold").alias("tp"), count("found and not is_gold").alias("fp"), count("is_gold and not found").alias("fn"))
    p = F.try_divide(F.col("tp") * 100.0, F.col("tp") + F.col("fp"))
    r = F.try_divide(F.col("tp") * 100.0, F.col("tp") + F.col("fn"))
    rated = sums.select("tp", "fp", "fn", p.alias("precision"), r.alias("recall"))
    f1 = F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return rated.withColumn("f1", f1)


def score_eval(matches: DataFrame, gold: DataFrame) -> DataFrame:
    """(name, term, match, score_eval): TP, FP, TN or FN; gold pairs that were no candidate are FN."""
    marked = gold.select("name", "term").distinct().withColumn("_g", F.lit(True))
    joined = matches.select("name", "term", "match").join(marked, ["name", "term"], "full")
    hit, true = F.coalesce("match", F.lit(False)), F.col("_g").isNotNull()
    kind = F.when(hit & true, "TP").when(hit, "FP").when(true, "FN").when(F.col("match").isNotNull(), "TN").otherwise("other")
    return joined.select("name", "term", "match", kind.alias("score_eval"))


def match_report(matches: DataFrame, gold: DataFrame) -> DataFrame:
    """precision_recall of the pairs that match."""
    return precision_recall(matches.where("coalesce(match, false)"), gold)


def review_pairs(scored: DataFrame, score: str, threshold: float, n: int = 2, gold: bool = False) -> DataFrame:
    """n pairs at or above a score that are not gold (or that are), in the order of a hash."""
    from ..functions.names import unit_hash

    return (
        scored.where((F.col(score) >= threshold) & (F.col("label") == gold))
        .orderBy(unit_hash(F.lit("review"), "name", "term"), "name", "term").limit(n)
    )


def training_report(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(label, gold, examples): how the labelled pairs divide."""
    rows = labels.join(pairs.select("name_id", "term_id", F.col("label").alias("gold")), ["name_id", "term_id"])
    return rows.groupBy("label", "gold").agg(F.count("*").alias("examples"))


def training_summary(labels: DataFrame, names: DataFrame, terms: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: examples (labelled pairs), gold (gold pairs), matches (labelled pairs whose name and term, by
    their ids, are a gold pair)."""
    named = labels.join(names.select("name_id", "name"), "name_id").join(terms.select("term_id", "term"), "term_id")
    known = named.join(gold.select("name", "term").distinct(), ["name", "term"], "left_semi")
    count = lambda df, kind: df.select(*[F.lit(int(k == kind)).alias(k) for k in ("examples", "gold", "matches")])
    rows = count(labels, "examples").unionByName(count(gold, "gold")).unionByName(count(known, "matches"))
    return rows.agg(*[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("examples", "gold", "matches")])
