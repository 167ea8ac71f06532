"""Feeding matches back: rewrite rules, expansion dictionaries and changed derived strings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import lower_alnum
from .align import best_alignment
from .derive import derived_strings


def abbreviation_uses(matches: DataFrame, scoring: str = "words", compat: bool = False) -> DataFrame:
    """(name, token, phrase): the best abbreviation windows of every matched pair (name, tokens, term_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, cache = [], {}
            for name, n, t in zip(*(batch.column(c).to_pylist() for c in ("name", "n", "t")), strict=True):
                _, _, windows = best_alignment(n, t, scoring=scoring, compat=compat, cache=cache)
                out += [(name, n[w[3]], " ".join(t[w[0] : w[1]])) for w in windows]
            cols = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["name", "token", "phrase"])

    rows = matches.select("name", lower_alnum(F.col("tokens")).alias("n"), lower_alnum(F.col("term_tokens")).alias("t"))
    return rows.mapInArrow(run, "name string, token string, phrase string")


#: So many different uses a task counts before it hands them on.
COUNTED = 200_000


def counted_uses(matches: DataFrame, scoring: str = "words", compat: bool = False) -> DataFrame:
    """(token, phrase, n): how many of abbreviation_uses a token and phrase have. Tasks count theirs first,
    so that what is shuffled grows with the words and not with the pairs. matches has (tokens, term_tokens)."""

    def counted(found: Counter) -> pa.RecordBatch:
        tokens, phrases = zip(*found, strict=True) if found else ((), ())
        cols = pa.array(tokens, pa.string()), pa.array(phrases, pa.string()), pa.array(found.values(), pa.int64())
        return pa.RecordBatch.from_arrays([*cols], names=["token", "phrase", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            cache = {}
            for n, t in zip(batch.column("n").to_pylist(), batch.column("t").to_pylist(), strict=True):
                tokens, words = n.split(" ") if n else [], t.split(" ") if t else []
                _, _, windows = best_alignment(tokens, words, scoring=scoring, compat=compat, cache=cache)
                found.update([(tokens[w[3]], " ".join(words[w[0] : w[1]])) for w in windows])
            if len(found) > COUNTED:
                yield counted(found)
                found.clear()
        yield counted(found)

    # tokens are letters and digits, so lists go as one string
    joined = lambda c: F.array_join(lower_alnum(F.col(c)), " ")
    rows = matches.select(joined("tokens").alias("n"), joined("term_tokens").alias("t"))
    return rows.mapInArrow(run, "token string, phrase string, n long").groupBy("token", "phrase").agg(F.sum("n").alias("n"))


def rewrite_rules(uses: DataFrame) -> DataFrame:
    """(token, expansion, score, rank): relative frequency of a token's phrases. uses are single ones, or counted (n)."""
    n = F.sum("n") if "n" in uses.columns else F.count("*")
    counts = uses.groupBy("token", F.col("phrase").alias("expansion")).agg(n.alias("n"))
    totals = counts.groupBy("token").agg(F.sum("n").alias("total"))
    scored = counts.join(totals, "token").select("token", "expansion", (F.col("n") / F.col("total")).alias("score"))
    order = Window.partitionBy("token").orderBy(F.desc("score"), "expansion")
    return scored.withColumn("rank", F.row_number().over(order))


def overall_entries(uses: DataFrame) -> DataFrame:
    """(token, expansion): what a token stood for, in any name."""
    return uses.select("token", F.col("phrase").alias("expansion")).distinct()


def expansion_dictionary(uses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((name, token, expansion), (token, expansion)): what a token stood for, by name and overall."""
    local = uses.select("name", "token", F.col("phrase").alias("expansion")).distinct()
    return local, overall_entries(uses)


def _entries(tokens: DataFrame, local: DataFrame, overall: DataFrame) -> DataFrame:
    """tokens (name, token, ...) with their dictionary expansions: the name's own where the name
    has any entry, else the overall ones; is_local says which."""
    owners = local.select("name").distinct()
    own = tokens.join(owners, "name", "left_semi").join(local, ["name", "token"]).withColumn("is_local", F.lit(True))
    rest = tokens.join(owners, "name", "left_anti").join(overall, "token").withColumn("is_local", F.lit(False))
    return own.unionByName(rest)


def boosted_rerank(candidates: DataFrame, local: DataFrame, overall: DataFrame, keep: int = 3, boost: tuple[float, float] = (0.4, 0.3)) -> DataFrame:
    """(name, pos, expansion, score, rank): candidates (name, pos, token, expansion, score) raised by
    boost[0] if in the name's dictionary, boost[1] if in the overall one; dictionary expansions
    that were no candidate join with the boost alone."""
    slots = candidates.select("name", "pos", "token").distinct()
    found = _entries(slots, local, overall).select(
        "name", "pos", "token", "expansion", F.when(F.col("is_local"), boost[0]).otherwise(boost[1]).alias("boost")
    )
    joined = candidates.join(found, ["name", "pos", "token", "expansion"], "full")
    score = F.coalesce("score", F.lit(0.0)) + F.coalesce("boost", F.lit(0.0))
    scored = joined.select("name", "pos", "token", "expansion", score.alias("score"))
    order = Window.partitionBy("name", "pos").orderBy(F.desc(F.round("score", 9)), "expansion")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def revise_rules(classified: DataFrame, combined: DataFrame, old: DataFrame, rules: DataFrame, keep: int = 3, beam: int = 10) -> DataFrame:
    """(name_id, derived, updated): derived strings after every position whose token has rules takes
    the best ``keep`` of them; updated says whether the list changed. old has (name_id, derived)."""
    best = rules.where(F.col("rank") <= keep).select("token", "expansion", "score", "rank")
    tokens = classified.select("name_id", "pos", F.lower("token").alias("token"))
    new = tokens.join(best, "token").select("name_id", "pos", "expansion", "score", "rank")
    kept = combined.join(new.select("name_id", "pos").distinct(), ["name_id", "pos"], "left_anti")
    fresh = derived_strings(kept.unionByName(new), beam)
    return fresh.join(old.withColumnRenamed("derived", "_old"), "name_id").select(
        "name_id", "derived",
        (~F.transform("derived", lambda d: d["text"]).eqNullSafe(F.transform("_old", lambda d: d["text"]))).alias("updated"),
    )


def _first_entries(dictionary: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first ``most`` distinct expansions of every key, in the order of their text."""
    order = Window.partitionBy(*keys).orderBy("expansion")
    rows = dictionary.select(*keys, "expansion").distinct().withColumn("_k", F.row_number().over(order))
    return rows.where(F.col("_k") <= most).drop("_k")


def first_products(options: Column, most: Column) -> Column:
    """The first ``most`` distinct strings of one option per position, in the order of their paths.

    options is an array of arrays of strings. Going from the last position to the first, the first
    ``most`` endings are all that the first ``most`` strings can have, so each step makes at most
    most * most strings, whatever the product's size.
    """
    def longer(endings: Column, some: Column) -> Column:
        joined = F.transform(some, lambda o: F.transform(endings, lambda e: F.when(e == "", o).otherwise(F.concat_ws(" ", o, e))))
        return F.slice(F.array_distinct(F.flatten(joined)), F.lit(1), most)

    return F.aggregate(F.reverse(options), F.array(F.lit("")), longer)


def merge_derived(names: DataFrame, local: DataFrame, overall: DataFrame, beam: int = 10) -> DataFrame:
    """(name_id, derived, updated): names (name_id, name, tokens, derived) with the strings that the
    dictionaries give, the best ``beam`` of them.

    A token stands for its expansions in the name's own dictionary, else for those in the overall
    one, else for itself. A name with entries of its own keeps only strings scored 1 and adds the
    made ones at 1; others add them at their top score (0.5 without any). Equal strings keep the
    higher score. Order: score, then strings that were there, then the made ones by path (options
    by their text). updated says whether a string is new or its score rose, of all that the
    dictionaries give. Made strings are listed lazily: beyond beam and those that the name has, none
    is needed. A null list of derived strings is an empty one.
    """
    given = names.select("name_id", "name", "tokens", F.coalesce("derived", F.array()).alias("derived"))
    most = beam + 1 + (given.agg(F.max(F.size("derived"))).first()[0] or 0)
    tokens = given.select("name_id", "name", F.posexplode(F.transform("tokens", F.lower)).alias("pos", "token"))
    own = tokens.join(_first_entries(local, ["name", "token"], most), ["name", "token"]).select("name_id", "pos", "expansion")
    general = tokens.join(local.select("name", "token").distinct(), ["name", "token"], "left_anti")
    shared = general.join(_first_entries(overall, ["token"], most), "token", "left").select("name_id", "pos", F.coalesce("expansion", "token").alias("expansion"))
    options = own.unionByName(shared).groupBy("name_id", "pos").agg(F.array_sort(F.collect_set("expansion")).alias("o"))
    lists = options.groupBy("name_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "o"))), lambda x: x["o"]).alias("l"))
    owners = local.select("name").distinct().withColumn("_has", F.lit(True))
    rows = given.join(owners, "name", "left").join(lists, "name_id", "left").withColumn("_has", F.col("_has").isNotNull())
    score = F.coalesce(F.array_max(F.transform("derived", lambda d: d["score"])), F.lit(0.5))
    rows = rows.select(
        "name_id", F.when(F.col("_has"), F.filter("derived", lambda d: d["score"] == 1.0)).otherwise(F.col("derived")).alias("kept"),
        F.when(F.col("_has"), 1.0).otherwise(score).alias("top"),
        F.when(F.col("l").isNull(), F.array().cast("array<string>")).otherwise(first_products(F.col("l"), F.lit(most))).alias("made"),
    )
    texts = F.transform("kept", lambda d: d["text"])
    same = lambda t: F.exists("kept", lambda d: (d["text"] == t) & (d["score"] == F.col("top")))
    best_of = lambda t: F.array_max(F.transform(F.filter("kept", lambda d: d["text"] == t), lambda d: d["score"]))
    entry = lambda s, fresh, i, t: F.struct((-F.round(s, 9)).alias("o"), F.lit(fresh).alias("n"), i.alias("i"), t.alias("text"), s.alias("score"))
    old = F.transform(
        F.array_distinct(texts), lambda t, i: entry(F.when(F.array_contains("made", t), F.greatest(best_of(t), F.col("top"))).otherwise(best_of(t)), 1, i, t)
    )
    new = F.transform(F.filter("made", lambda t: ~F.array_contains(texts, t)), lambda t, i: entry(F.col("top"), 2, i, t))
    ordered = F.slice(F.array_sort(F.concat(old, new)), 1, beam)
    return rows.select(
        "name_id", F.transform(ordered, lambda x: F.struct(x["text"].alias("text"), x["score"].alias("score"))).alias("derived"),
        F.exists("made", lambda t: ~same(t)).alias("updated"),
    )


def past_examples(labels: DataFrame, candidates: DataFrame, names: DataFrame, terms: DataFrame) -> DataFrame:
    """candidates and, beside them, labelled pairs that are no candidate any more."""
    missing = labels.select("name_id", "term_id").join(candidates, ["name_id", "term_id"], "left_anti")
    full = missing.join(names.select("name_id", "name"), "name_id").join(terms.select("term_id", "term"), "term_id")
    return candidates.unionByName(full, allowMissingColumns=True)


def refresh_derived(candidates: DataFrame, revised: DataFrame) -> DataFrame:
    """candidates with the derived strings and updated flags of revised (name_id, derived, updated)."""
    return candidates.drop("derived", "updated").join(revised, "name_id", "left")


def reuse_features(candidates: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """candidates with the features that an earlier round computed; null where a pair is new."""
    return candidates.join(features.select("name_id", "term_id", *columns), ["name_id", "term_id"], "left")


def derived_key(derived: Column, top: int = 10) -> Column:
    """A hash of the first derived strings: features are the same while it is."""
    return F.xxhash64(F.transform(F.slice(derived, 1, top), lambda d: d["text"]))


def changes(pairs: DataFrame, scored: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """pairs (name_id, term_id, derived, ...) with the features ``columns`` and derived_key of an earlier round's
    scored: null where the pair is new, and updated where the name's first strings are others than then.

    What score_incremental computes follows from these alone, so a pair is rescored only for a change."""
    before = scored.select("name_id", "term_id", *columns, F.col("derived_key").alias("_before"))
    now = pairs.drop("derived_key", "updated").withColumn("derived_key", derived_key(F.col("derived"), top))
    met = now.join(before, ["name_id", "term_id"], "left")
    return met.withColumn("updated", ~F.col("_before").eqNullSafe(F.col("derived_key"))).drop("_before")
