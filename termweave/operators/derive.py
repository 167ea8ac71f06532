"""Candidate lists per position and the derived strings of a name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def combined_candidates(classified: DataFrame, ranked: DataFrame) -> DataFrame:
    """(name_id, pos, expansion, score, rank): English tokens as they are (0.99), noisy ones with
    their ranked expansions, noisy ones without any as they are (-1)."""
    english = classified.where("english").select(
        "name_id", "pos", F.lower("token").alias("expansion"), F.lit(0.99).alias("score"), F.lit(1).alias("rank")
    )
    alone = classified.where(~F.col("english")).join(ranked, ["name_id", "pos"], "left_anti").select(
        "name_id", "pos", F.lower("token").alias("expansion"), F.lit(-1.0).alias("score"), F.lit(1).alias("rank")
    )
    return english.unionByName(ranked.select("name_id", "pos", "expansion", "score", "rank")).unionByName(alone)


def packed_candidates(combined: DataFrame) -> DataFrame:
    """(name_id, lists): for every position in order the array of (expansion, score) by rank."""
    by_pos = combined.groupBy("name_id", "pos").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "expansion", "score"))), lambda x: F.struct(x["expansion"].alias("text"), x["score"].alias("score"))).alias("list")
    )
    packed = by_pos.groupBy("name_id").agg(F.array_sort(F.collect_list(F.struct("pos", "list"))).alias("l"))
    return packed.select("name_id", F.transform("l", lambda x: x["list"]).alias("lists"))


def products(lists: Column, beam: int) -> Column:
    """The combinations of one candidate per position as (text, score, path), best first.

    The score is the product; -1 and 0 count as neutral, and a product of neutral scores alone is
    0. Only the ``beam`` largest and smallest partial products are carried on (scores can be
    negative), apart from the all-neutral ones, of which the first ``beam`` are; so the first
    ``beam`` results equal those of the full product.
    """
    start = F.array(F.struct(F.lit("").alias("text"), F.lit(1.0).alias("score"), F.lit(False).alias("scored"), F.array().cast("array<int>").alias("path")))

    def extended(acc: Column, options: Column) -> Column:
        def step(a: Column) -> Column:
            return F.transform(options, lambda o, i: F.struct(
                F.when(a["text"] == "", o["text"]).otherwise(F.concat_ws(" ", a["text"], o["text"])).alias("text"),
                F.when(o["score"].isin(-1.0, 0.0), a["score"]).otherwise(a["score"] * o["score"]).alias("score"),
                (a["scored"] | ~o["score"].isin(-1.0, 0.0)).alias("scored"),
                F.array_append(a["path"], i).alias("path"),
            ))

        everything = F.flatten(F.transform(acc, step))
        scored = F.filter(everything, lambda x: x["scored"])
        neutral = F.filter(everything, lambda x: ~x["scored"])
        # of equal scores the first paths are kept at either end
        ends = F.array_union(F.slice(best_first(scored), 1, beam), F.slice(best_first(scored, -1), 1, beam))
        return F.concat(ends, F.slice(neutral, 1, beam))

    done = F.aggregate(lists, start, extended)
    ended = F.transform(done, lambda x: F.struct(x["text"].alias("text"), F.when(x["scored"], x["score"]).otherwise(0.0).alias("score"), x["path"].alias("path")))
    return F.slice(best_first(ended), 1, beam)


def best_first(items: Column, sign: int = 1) -> Column:
    """Sorted by falling score (rising, with sign -1), then by path."""
    return F.transform(
        F.array_sort(F.transform(items, lambda x: F.struct(F.round(-sign * x["score"], 9).alias("s"), x["path"].alias("p"), x.alias("x")))),
        lambda y: y["x"],
    )


def derived_strings(combined: DataFrame, beam: int = 10) -> DataFrame:
    """(name_id, derived): the best ``beam`` derived strings as an array of (text, score)."""
    best = products(F.col("lists"), beam)
    return packed_candidates(combined).select(
        "name_id", F.transform(best, lambda x: F.struct(x["text"].alias("text"), x["score"].alias("score"))).alias("derived")
    )


def dedup_derived(derived: DataFrame) -> DataFrame:
    """(name_id, text, score): the highest score of every derived string."""
    rows = derived.select("name_id", F.explode("derived").alias("d"))
    return rows.groupBy("name_id", F.col("d.text").alias("text")).agg(F.max("d.score").alias("score"))
