"""Ranking expansions by the similarity of a name's context and an expansion's corpus contexts."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import STOP_WORDS, cosine, lower_words, starts_with_letter, without
from ..session import shared_dir

#: Characters that part the words of a corpus cell, and a word with the one behind it.
BREAKS = r";:'/. ,&()_-"
CELL_BREAK, PIECE = f"[{BREAKS}]", rf"[^{BREAKS}]*[{BREAKS}]|[^{BREAKS}]+\z"
#: So many cells at most are named in a broadcast.
FEW_CELLS = 100_000


def postings(corpus: DataFrame, reach: int, words: int, pieces: int, stop: list[str] = STOP_WORDS) -> DataFrame:
    """(word, cell_id, pos, size, around, as_is): every word of two characters or more that is no stop word,
    with its place among these in its cell (cell_id, text).

    around are the words from ``reach`` before it on, ``words`` + ``reach`` from its own place on; as_is is
    the cell's lower-case text from the word on, for ``pieces`` words of any kind. Both are cut within
    the row, so a posting's size does not grow with its cell's.
    """
    raw = corpus.select("cell_id", F.regexp_extract_all(F.lower("text"), F.lit(PIECE), F.lit(0)).alias("p"))
    bare = F.transform("p", lambda x, i: F.struct(F.regexp_replace(x, CELL_BREAK, "").alias("w"), i.alias("i")))
    kept = raw.select("cell_id", "p", F.filter(bare, lambda x: (F.length(x["w"]) > 1) & ~x["w"].isin(stop)).alias("k"))
    kept = kept.select("cell_id", "p", "k", F.transform("k", lambda x: x["w"]).alias("w"))
    made = F.transform("k", lambda x, at: F.struct(
        x["w"].alias("word"), at.alias("pos"), F.size("w").alias("size"),
        F.slice("w", F.greatest(at - reach, F.lit(0)) + 1, F.least(at, F.lit(reach)) + words + reach).alias("around"),
        F.array_join(F.slice("p", x["i"] + 1, pieces), "").alias("as_is"),
    ))
    return kept.select("cell_id", F.explode(made).alias("x")).select("cell_id", "x.*")


def candidate_context(corpus: DataFrame, expansions: DataFrame, reach: int = 3, stop: list[str] = STOP_WORDS) -> DataFrame:
    """(expansion, cell_id, window): token windows around an expansion in corpus cells (cell_id, text).

    A cell must contain the expansion as it stands; it is then searched from left to right in the
    cell's tokens, and after a window the search goes on behind it. An expansion of stop words
    and single letters only has no context. Cell ids are distinct; null texts have no words.

    Postings meet the expansions on their first word, and a window is made of the words that its
    postings carry. Where an expansion stands as it is at one of its places, the posting shows it;
    only for the other pairs of expansion and cell the cells' texts are looked at again.
    """
    asked = expansions.select("expansion").distinct().select(
        "expansion", without(F.filter(F.split("expansion", "[ -]"), lambda x: F.length(x) > 1), stop).alias("run")
    ).where(F.size("run") > 0).withColumn("word", F.col("run")[0])
    longest = asked.agg(F.max(F.size("run")).alias("n"), F.max(F.size(F.split("expansion", CELL_BREAK))).alias("p")).first()
    places = postings(corpus, reach, longest["n"] or 1, longest["p"] or 1, stop)
    found = places.join(asked, "word")
    found = found.where(F.slice("around", F.least(F.col("pos"), F.lit(reach)) + 1, F.size("run")) == F.col("run"))
    alone = ~F.col("expansion").rlike(CELL_BREAK)
    by_cell = found.groupBy("expansion", "cell_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "around"))).alias("hits"), F.first("size").alias("size"),
        F.first(F.size("run")).alias("n"), F.max(alone | F.startswith("as_is", "expansion")).alias("as_is"),
    )
    shared_dir(corpus.sparkSession)
    by_cell = by_cell.checkpoint()
    sure, open_pairs = by_cell.where("as_is"), by_cell.where("not as_is")
    if not open_pairs.isEmpty():
        ids = open_pairs.select("cell_id").distinct()
        texts = corpus.select("cell_id", F.lower("text").alias("raw"))
        some = texts.join(F.broadcast(ids) if ids.count() <= FEW_CELLS else ids, "cell_id", "left_semi")
        sure = sure.unionByName(open_pairs.join(some, "cell_id").where(F.col("raw").contains(F.col("expansion"))).drop("raw"))
    # a single word reaches two tokens to its right, a phrase three
    right = F.when(F.col("expansion").contains(" "), F.col("n") + reach).otherwise(F.lit(reach))
    step = (
        "aggregate(hits, struct(0 as start, cast(array() as array<array<string>>) as w), (s, h) -> if(h.pos >= s.start, struct("
        "int(least(h.pos + right, size)) as start, concat(s.w, array(slice(h.around, "
        f"int(greatest(h.pos - {reach}, s.start) - greatest(h.pos - {reach}, 0)) + 1, "
        f"int(least(h.pos + right, size) - greatest(h.pos - {reach}, s.start))))) as w), s)).w"
    )
    return sure.withColumn("right", right).select("expansion", "cell_id", F.explode(F.expr(step)).alias("window"))


def _summed(rows: DataFrame, key: str, weight: Column) -> DataFrame:
    """(key, vector): the sum of weight * vector, one row a vector (vectors of one length)."""
    x = F.transform("vector", lambda c: c * F.col("_w"))
    summed = rows.withColumn("_w", weight).groupBy(key).agg(Summarizer.sum(array_to_vector(x)).alias("v"))
    return summed.select(key, vector_to_array("v").alias("vector"))


def name_context_vector(names: DataFrame, vectors: DataFrame) -> DataFrame:
    """(name_id, vector): mean vector of a name's word tokens of two characters or more, repeats
    counted; names without a known token have no row."""
    words = names.select("name_id", F.explode(lower_words(F.col("tokens"))).alias("word")).where(F.length("word") > 1)
    known = words.join(vectors, "word").groupBy("name_id").agg(Summarizer.mean(array_to_vector(F.col("vector"))).alias("v"))
    return known.select("name_id", vector_to_array("v").alias("vector"))


def expansion_vector(contexts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(expansion, vector): sum of context token vectors, weighted by relative frequency; unknown
    tokens count in the total."""
    tokens = contexts.select("expansion", F.explode("window").alias("word"))
    counts = tokens.groupBy("expansion", "word").agg(F.count("*").alias("n"))
    totals = counts.groupBy("expansion").agg(F.sum("n").alias("total"))
    weighted = counts.join(totals, "expansion").where(F.length("word") > 1).join(vectors, "word")
    return _summed(weighted, "expansion", F.col("n") / F.col("total"))


def rank_expansions(
    classified: DataFrame, expansions: DataFrame, name_vectors: DataFrame, expansion_vectors: DataFrame,
    vectors: DataFrame, keep: int = 3,
) -> DataFrame:
    """(name_id, pos, expansion, score, rank): the best expansions of every noisy token of a name.

    Expansions without a vector, and phrases with an unknown word, are left out; a name without a
    vector scores all 0. A noisy token that starts with no letter is its own expansion, score 0.
    """
    noisy = classified.where(~F.col("english")).select("name_id", "pos", F.lower("token").alias("token"), "token")
    noisy = noisy.toDF("name_id", "pos", "token", "given")
    words = expansions.select("expansion", F.explode(F.split("expansion", " ")).alias("word")).distinct()
    unknown = words.where(F.col("expansion").contains(" ")).join(vectors.select("word"), "word", "left_anti")
    usable = expansions.join(unknown.select("expansion").distinct(), "expansion", "left_anti").join(expansion_vectors, "expansion")
    scored = (
        noisy.where(starts_with_letter(F.col("given"))).join(usable, "token")
        .join(name_vectors.withColumnRenamed("vector", "name_vector"), "name_id", "left")
        .select("name_id", "pos", "expansion", F.coalesce(cosine(F.col("name_vector"), F.col("vector")), F.lit(0.0)).alias("score"))
    )
    own = noisy.where(~starts_with_letter(F.col("given"))).select("name_id", "pos", F.col("given").alias("expansion"), F.lit(0.0).alias("score"))
    order = Window.partitionBy("name_id", "pos").orderBy(F.desc(F.round("score", 9)), "expansion")
    ranked = scored.unionByName(own).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= keep)
