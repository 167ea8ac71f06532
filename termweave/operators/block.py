"""Blocking: an inverted index over term tokens and the candidate pairs it gives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import STOP_WORDS, starts_with_letter
from ..session import few, shared_dir, written

#: Posting lists: so many tokens at most are sent to every task with their frequency, and so many bytes of
#: terms and their tokens are listed at a time.
SENT_TOKENS, RUN_BYTES = 250_000, 16 << 20


def index_tokens(terms: DataFrame, stop: list[str] = STOP_WORDS, once: bool = False) -> DataFrame:
    """Distinct (token, term): lower-case tokens that start with a letter and are no stop word.

    Where terms has every term ``once``, only a row's own tokens are made distinct, and nothing is shuffled.
    """
    if once:
        own = terms.select(F.explode(F.array_distinct(F.transform("tokens", F.lower))).alias("token"), "term")
        return own.where(starts_with_letter(F.col("token")) & ~F.col("token").isin(stop))
    tokens = terms.select("term", F.explode("tokens").alias("t")).where(starts_with_letter(F.col("t")))
    return tokens.select(F.lower("t").alias("token"), "term").where(~F.col("token").isin(stop)).distinct()


def own_tokens(terms: DataFrame, stop: list[str] = STOP_WORDS) -> DataFrame:
    """(term, tokens): each term's distinct tokens, as index_tokens has them."""
    lower = F.array_distinct(F.transform("tokens", F.lower))
    return terms.select("term", F.filter(lower, lambda x: starts_with_letter(x) & ~x.isin(stop)).alias("tokens"))


def capped_tokens(index: DataFrame, cap: int = 300) -> DataFrame:
    """(token, df) of the tokens with fewer than ``cap`` terms."""
    return index.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") < cap)


def inverted_index(index: DataFrame, size: int = 1000) -> DataFrame:
    """(token, block, terms, df): the terms of every token, in sorted lists of at most ``size``.

    index has distinct (token, term), or each term once with its distinct tokens (own_tokens), and is read once.
    Lists of the most frequent tokens, SENT_TOKENS at most, are made in the task that has their terms, from
    RUN_BYTES of terms at a time, so that no shuffle or sort writes their postings to disk. Only postings of the
    other tokens, where there are more, meet by a shuffle; such a token has fewer than 2 / SENT_TOKENS of all
    postings. block tells a token's lists apart.
    """
    tokens = F.array("token") if "token" in index.columns else F.col("tokens")
    rows = written(index.where("term is not null").select("term", tokens.alias("tokens")), tidy=True)
    postings = rows.select(F.explode("tokens").alias("token"), "term").where("token is not null")
    counts = written(postings.groupBy("token").agg(F.count("*").alias("df")), tidy=True)
    least = _least_sent(counts)
    counts = counts.where(F.col("df") >= least)
    sent = index.sparkSession.sparkContext.broadcast(counts.toArrow())
    lists = rows.mapInArrow(lambda batches: _posting_lists(batches, sent.value, size), "token string, terms array<string>, df long")
    if least > 1:
        met = postings.join(F.broadcast(counts), "token", "left_anti").repartition("token").groupBy("token")
        met = met.agg(F.sort_array(F.collect_list("term")).alias("all"), F.count("*").alias("df"))
        starts = F.sequence(F.lit(1), F.size("all"), F.lit(size))
        lists = lists.unionByName(met.select("token", F.explode(F.transform(starts, lambda i: F.slice("all", i, size))).alias("terms"), "df"))
    return lists.select("token", F.monotonically_increasing_id().alias("block"), "terms", "df")


def _least_sent(counts: DataFrame) -> int:
    """The smallest power of two such that no more than SENT_TOKENS tokens have that frequency."""
    reach = 0
    for bits, n in sorted(counts.groupBy(F.length(F.bin("df"))).count().collect(), reverse=True):
        reach += n
        if reach > SENT_TOKENS:
            return 2**bits
    return 1


def _posting_lists(batches: Iterator[pa.RecordBatch], sent: pa.Table, size: int) -> Iterator[pa.RecordBatch]:
    """(token, terms, df) lists of the batches' (term, tokens) for the tokens of sent (token, df), from RUN_BYTES at a time."""
    held, held_bytes = [], 0
    for batch in batches:
        held.append(batch)
        held_bytes += batch.nbytes
        if held_bytes >= RUN_BYTES:
            yield _run_lists(held, sent, size)
            held, held_bytes = [], 0
    if held_bytes:
        yield _run_lists(held, sent, size)


def _run_lists(batches: list[pa.RecordBatch], sent: pa.Table, size: int) -> pa.RecordBatch:
    term, tokens = [c.combine_chunks() for c in pa.Table.from_batches(batches).columns]
    owner, token = pc.list_parent_indices(tokens).to_numpy(), pc.list_flatten(tokens).dictionary_encode()
    at = pc.index_in(token.dictionary, value_set=sent["token"]).fill_null(-1).to_numpy()
    # a null token is as one that is not sent
    code = token.indices.fill_null(len(at)).to_numpy()
    own = np.flatnonzero(np.append(at, -1)[code] >= 0)
    code, owner = code[own].astype(np.int64), owner[own]
    coded = term.dictionary_encode()
    rank = np.empty(len(coded.dictionary), np.int64)
    rank[pc.sort_indices(coded.dictionary).to_numpy()] = np.arange(len(rank))
    order = np.argsort(code * len(rank) + rank[coded.indices.to_numpy()[owner]])
    code = code[order]
    begin = np.flatnonzero(np.diff(code, prepend=-1))
    place = np.arange(len(code)) - np.repeat(begin, np.diff(begin, append=len(code)))
    first = np.flatnonzero(place % size == 0)
    terms = pa.ListArray.from_arrays(pa.array([*first, len(code)], pa.int32()), term.take(pa.array(owner[order])))
    columns = [token.dictionary.take(pa.array(code[first])), terms, sent["df"].take(pa.array(at[code[first]])).combine_chunks()]
    return pa.RecordBatch.from_arrays(columns, ["token", "terms", "df"])


def _grid(left: DataFrame, right: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """left and right (token, key, ...) with _l and _r, so that joined on token, _l and _r every pair of
    rows of a token meets once, and no more than about size * size of them under one key."""
    counts = lambda df, name: df.groupBy("token").agg(F.ceil(F.count("*") / size).alias(name))
    cells = counts(left, "_nl").join(counts(right, "_nr"), "token").where("_nl > 1 or _nr > 1").checkpoint()
    if cells.isEmpty():
        one = F.lit(0).cast("long")
        return left.withColumns({"_l": one, "_r": one}), right.withColumns({"_l": one, "_r": one})
    cells = few(cells)

    def dealt(df: DataFrame, own: str, other: str, n_own: str, n_other: str) -> DataFrame:
        n, m = F.coalesce(n_own, F.lit(1)), F.coalesce(n_other, F.lit(1))
        rows = df.join(cells, "token", "left").withColumn(own, F.pmod(F.xxhash64("key"), n))
        return rows.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), m - 1))).drop("_nl", "_nr")

    return dealt(left, "_l", "_r", "_nl", "_nr"), dealt(right, "_r", "_l", "_nr", "_nl")


def block_candidates(
    names: DataFrame, terms: DataFrame, top: int = 10, cap: int = 300, stop: list[str] = STOP_WORDS, size: int = 1000,
    once: bool = False, part: DataFrame | None = None,
) -> DataFrame:
    """Candidate pairs: names (name_id, name, derived) and terms (term_id, term, tokens) that share a
    word of one of the first ``top`` derived strings, below the frequency cap. Equal terms give a pair
    for each id, and repeated rows of a term one for each; name ids are distinct.

    A pair that shares several tokens is made at the smallest of them alone, which both rows can tell
    from the tokens that they carry, so pairs are not made distinct by a shuffle. Tokens with more
    than ``size`` rows on a side are joined in cells of about size * size pairs.

    Only words that a name asks for are counted and carried, and words that reach the cap in ``part`` of the
    terms' rows (by default a 16th of the terms) are told first, so that the rows of the most frequent words are
    neither made distinct nor carried. terms without term_id give a pair for each distinct term, and pairs have
    none. There, and where terms has every term ``once``, one search of all terms keeps the rows of the words
    that are not told, whose number depends on the words and the cap, not on the terms.
    """
    shared_dir(terms.sparkSession)
    ids = [c for c in ("term_id", "term") if c in terms.columns]
    distinct = once or ids == ["term"]

    def listed_words(rows: DataFrame) -> DataFrame:
        return rows.select(*ids, F.array_distinct(F.transform("tokens", F.lower)).alias("tokens"))

    listed = listed_words(terms)
    if not distinct:
        listed = listed.checkpoint()
    texts = F.transform(F.slice("derived", 1, top), lambda d: F.split(d["text"], " "))
    words = names.select("name_id", "name", F.explode(F.array_distinct(F.flatten(texts))).alias("token"))
    words = words.where(starts_with_letter(F.col("token")) & ~F.col("token").isin(stop)).checkpoint()
    asked = words.select("token").distinct().checkpoint()

    def holding(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        """The rows' ids with each wanted word that they hold."""
        # not explode: it would have rows without tokens sought before, for which all tokens are made once more
        return rows.select(*ids, F.explode_outer("tokens").alias("token")).join(few(wanted), "token", "left_semi")

    def reaching(rows: DataFrame, apart: bool) -> DataFrame:
        rows = rows if apart else rows.select("term", "token").distinct()
        return rows.groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= cap).select("token").checkpoint()

    part = listed.where(F.pmod(F.xxhash64("term"), F.lit(16)) == 0) if part is None else listed_words(part)
    told = reaching(holding(part, asked), once)
    held = holding(listed, asked.join(few(told), "token", "left_anti").checkpoint())
    if distinct:
        held = (held if once else held.distinct()).checkpoint()
    frequent = told.unionByName(reaching(held, distinct))
    words = words.join(few(frequent), "token", "left_anti").groupBy("name_id", "name").agg(F.collect_set("token").alias("words")).checkpoint()
    left = words.select("*", F.xxhash64("name_id", "name").alias("key"), F.explode("words").alias("token"))
    rare = left.select("token").distinct().checkpoint()
    if distinct:
        found = held.join(few(rare), "token", "left_semi").groupBy(*ids).agg(F.collect_set("token").alias("tokens"))
        right = found.select("*", F.explode("tokens").alias("token")).checkpoint()
    else:
        right = listed.select("*", F.explode("tokens").alias("token")).join(few(rare), "token", "left_semi").checkpoint()
    right = right.withColumn("key", F.xxhash64(*ids))
    left, right = _grid(left, right, size)
    met = left.drop("key").join(right.drop("key"), ["token", "_l", "_r"])
    return met.where(F.col("token") == F.array_min(F.array_intersect("tokens", "words"))).select("name_id", "name", *ids)


def blocking_stats(candidates: DataFrame, gold: DataFrame, n_names: int, n_terms: int) -> DataFrame:
    """One row: pairs, share of all pairs, and recall of gold pairs."""
    counts = F.lit(1).alias("pairs"), F.lit(0).alias("hits"), F.lit(0).alias("gold")
    pairs = candidates.select(*counts)
    found = gold.join(candidates.select("name", "term").distinct(), ["name", "term"], "left_semi")
    found = found.select(F.lit(0).alias("pairs"), F.lit(1).alias("hits"), F.lit(0).alias("gold"))
    total = gold.select(F.lit(0).alias("pairs"), F.lit(0).alias("hits"), F.lit(1).alias("gold"))
    sums = pairs.unionByName(found).unionByName(total).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("pairs", "hits", "gold")])
    return sums.select(
        "pairs", F.try_divide(F.col("pairs").cast("double"), F.lit(float(n_names)) * n_terms).alias("ratio"),
        F.try_divide(F.col("hits").cast("double"), F.col("gold")).alias("recall"),
    )
