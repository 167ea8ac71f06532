"""The twelve features of a candidate pair.

Token counts and 3-gram overlaps are column functions. Alignments go through one mapInArrow job
over pairs that are dealt by hash, since pairs of one name cost alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import MATCH_STOP_WORDS, lower_alnum, matching_tokens, set_jaccard, trigrams, without
from .align import Cache, affine, best_alignment, greedy_overlap, smith_waterman

FEATURES = [
    "overlap_coeff", "jaccard_coeff", "abbr_jaccard_coeff", "abbr_jaccard_coeff_no_stopwords", "rel_diff_num_tokens",
    "affine_dist", "smith_waterman_dist", "smith_waterman_coeff", "abs_diff_num_tokens",
    "normalized_3gram_jaccard_coeff", "normalized_smith_waterman_dist", "normalized_smith_waterman_coeff",
]
NORMALIZED = FEATURES[9:]
_ALIGNED = ["overlap", "abbr_num", "abbr_den", "bare_num", "bare_den", "affine_dist", "smith_waterman_dist", "best_sw", "best_len"]


def _align_rows(full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, t, nb, tb, nm, tm, derived = (batch.column(c).to_pylist() for c in ("_n", "_t", "_nb", "_tb", "_nm", "_tm", "_derived"))
            rows = len(n)
            terms = [" ".join(x) for x in t]
            new = {c: np.zeros(rows) for c in _ALIGNED}
            if full:
                cache: Cache = {}
                for i in range(rows):
                    whole = best_alignment(n[i], t[i], cache=cache)
                    bare = whole if (nb[i], tb[i]) == (n[i], t[i]) else best_alignment(nb[i], tb[i], cache=cache)
                    new["abbr_num"][i], new["abbr_den"][i], new["bare_num"][i], new["bare_den"][i] = *whole[:2], *bare[:2]
                new["overlap"][:] = [*map(greedy_overlap, nm, tm)]
                joined = [(" ".join(x), y) for x, y in zip(n, terms, strict=True)]
                new["affine_dist"], new["smith_waterman_dist"] = affine(joined), smith_waterman(joined)
            # each string of a name and each term meet once, however many rows have the two
            places = [[(text, term) for text in some or ()] for some, term in zip(derived, terms, strict=True)]
            distinct = {pair: k for k, pair in enumerate(dict.fromkeys(chain.from_iterable(places)))}
            scores = smith_waterman([*distinct], gap=1.0)
            for i, some in enumerate(places):
                found = scores[[distinct[p] for p in some]] if some else np.zeros(1)
                if found.max() > 0:
                    new["best_sw"][i], new["best_len"][i] = found.max(), len(some[int(found.argmax())][0])
            given = [batch.column(i) for i in range(batch.num_columns - 7)]
            names = batch.schema.names[:-7] + [f"_{c}" for c in _ALIGNED]
            yield pa.RecordBatch.from_arrays(given + [pa.array(new[c]) for c in _ALIGNED], names=names)

    return run


def name_grams(derived: Column, top: int = 10) -> Column:
    """The 3-gram sets of the first derived strings: made once for each name, before it meets terms."""
    return F.transform(F.slice(derived, 1, top), lambda d: trigrams(d["text"]))


def term_grams(tokens: Column) -> Column:
    """The 3-gram set of a term."""
    return trigrams(F.array_join(lower_alnum(tokens), " "))


def gram_similarity(names: Column, term: Column) -> Column:
    """The best Jaccard similarity of a term's 3-grams with those of a name; 0 without any."""
    # the term's set is made once, as the only element of another
    best = F.transform(F.array(term), lambda t: F.array_max(F.transform(names, lambda d: set_jaccard(d, t))))
    return F.coalesce(F.get(best, F.lit(0)), F.lit(0.0))


def _prepared(pairs: DataFrame, top: int, stop: list[str]) -> DataFrame:
    n, t = lower_alnum(F.col("tokens")), lower_alnum(F.col("term_tokens"))
    texts = F.transform(F.slice("derived", 1, top), lambda d: d["text"])
    rows = pairs.withColumns({"_n": n, "_t": t})
    return rows.withColumns({
        "_nb": without(F.col("_n"), stop), "_tb": without(F.col("_t"), stop),
        "_nm": matching_tokens(F.col("_n"), stop), "_tm": matching_tokens(F.col("_t"), stop), "_derived": texts,
    })


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _scored(pairs: DataFrame, top: int, stop: list[str], full: bool) -> DataFrame:
    made_here = ("derived_grams", "term_grams")
    given = [c for c in pairs.columns if c not in made_here and (c not in FEATURES or (not full and c not in NORMALIZED))]
    for column, made in (("derived_grams", name_grams(F.col("derived"), top)), ("term_grams", term_grams(F.col("term_tokens")))):
        if column not in pairs.columns:
            pairs = pairs.withColumn(column, made)
    rows = _prepared(pairs.select(*given, "derived_grams", "term_grams"), top, stop)
    counts = {"_n1": F.size("_nm"), "_n2": F.size("_tm"), "_r1": F.size("_n"), "_r2": F.size("_t"), "_b1": F.size("_nb"), "_b2": F.size("_tb")}
    gram = gram_similarity(F.col("derived_grams"), F.col("term_grams"))
    rows = rows.withColumns({**counts, "_gram": gram, "_nl": F.length(F.array_join("_n", " ")), "_tl": F.length(F.array_join("_t", " "))})
    args = ["_n", "_t", "_nb", "_tb", "_nm", "_tm", "_derived"]
    rows = rows.select(*[c for c in rows.columns if c not in (*args, *made_here)], *args)
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(tasks, F.xxhash64("name_id", "term_id"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields[:-7]] + [f"_{c} double" for c in _ALIGNED]
    out = dealt.mapInArrow(_align_rows(full), ", ".join(kinds))
    new: dict[str, Column] = {}
    if full:
        gap = [
            F.when(F.col(d) > 0, F.col(d) - F.col(m)).otherwise(F.col(a) + F.col(b))
            for d, m, a, b in (("_abbr_den", "_abbr_num", "_r1", "_r2"), ("_bare_den", "_bare_num", "_b1", "_b2"))
        ]
        new = {
            "overlap_coeff": _ratio(F.col("_overlap"), F.least("_n1", "_n2")),
            "jaccard_coeff": _ratio(F.col("_overlap"), F.col("_n1") + F.col("_n2") - F.col("_overlap")),
            "abbr_jaccard_coeff": _ratio(F.col("_abbr_num"), F.col("_abbr_den")),
            "abbr_jaccard_coeff_no_stopwords": _ratio(F.col("_bare_num"), F.col("_bare_den")),
            "rel_diff_num_tokens": F.least(*gap).cast("double"),
            "affine_dist": F.col("_affine_dist"), "smith_waterman_dist": F.col("_smith_waterman_dist"),
            "smith_waterman_coeff": _ratio(F.col("_smith_waterman_dist"), 2.0 * F.greatest("_nl", "_tl")),
            "abs_diff_num_tokens": F.abs(F.col("_n1") - F.col("_n2")).cast("double"),
        }
    new |= {
        "normalized_3gram_jaccard_coeff": F.col("_gram"), "normalized_smith_waterman_dist": F.col("_best_sw"),
        "normalized_smith_waterman_coeff": _ratio(F.col("_best_sw"), 2.0 * F.greatest(F.col("_best_len"), F.col("_tl"))),
    }
    return out.select(*given, *[v.cast("double").alias(k) for k, v in new.items()])


def score_pairs(pairs: DataFrame, top: int = 10, stop: list[str] = MATCH_STOP_WORDS) -> DataFrame:
    """pairs (name_id, tokens, derived, term_id, term_tokens, ...) with all twelve features.

    Where pairs has derived_grams and term_grams (name_grams, term_grams) they are used; they cost
    less made once for each name and term than for each pair.
    """
    return _scored(pairs, top, stop, full=True)


def score_incremental(pairs: DataFrame, top: int = 10, stop: list[str] = MATCH_STOP_WORDS) -> DataFrame:
    """pairs with the features of an earlier round (null where new) and updated: new pairs get all
    features, pairs whose derived strings changed the normalised ones, the others keep theirs."""
    fresh = _scored(pairs.where("overlap_coeff is null"), top, stop, full=True)
    seen = pairs.where("overlap_coeff is not null")
    changed = _scored(seen.where("coalesce(updated, false)"), top, stop, full=False)
    columns = [c for c in pairs.columns if c not in (*FEATURES, "derived_grams", "term_grams")] + FEATURES
    kept = seen.where("not coalesce(updated, false)")
    return fresh.select(columns).unionByName(changed.select(columns)).unionByName(kept.select(columns))
