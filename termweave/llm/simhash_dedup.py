"""SimHash near-dedup with pivot distance tables.

Equal fingerprints are one class. Between classes, a pair is looked at only where it shares a key.
Within a bucket of one key the Hamming distances of each fingerprint to many reference
fingerprints (pivots) are tabled; as |d(x, p) - d(y, p)| <= d(x, y), a pair whose largest
coordinate difference exceeds ``distance`` is discarded, and what survives all coordinates is
verified bit by bit. Buckets over ``bucket_rows`` are cut into sub-blocks and every pair of
sub-blocks is a task of its own. A task returns a spanning forest of its links, never all pairs.

* **By distance** (the default): links are fingerprints within ``distance`` bits. The keys are
  equal parts of the fingerprint: of ``parts`` parts at least ``parts - distance`` are equal then.
  The keys are what keeps the search small; pivots discard within buckets. More parts are taken
  above 4e6 and 1e9 classes, which changes the cost and never the links.
* **By similarity** (``similarity=0.8``): links are shingle sets with Jaccard >= 4/5, exactly. Such
  fingerprints differ by about ten bits of 64, too far for equal parts, so the keys are rare shared
  shingles (see shingle_sets). Fingerprints (of the distinct shingles) discard what lies beyond
  ``distance``, five standard deviations above the expected distance at 4/5, where both sets have
  SURE shingles or more; at such a distance pivots discard little. Survivors form families, and
  within these whole sets are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialised, per_document, record, utf8, written
from .components import connected_components
from .shingle_sets import candidate_sets, set_class, shingle_set, similar_components
from .wordhash import ascii_words, mixed

#: Reference fingerprints: a fixed pseudo-random set.
PIVOTS = mixed(np.arange(1, 33, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Shingles from which on a set's fingerprint may discard a pair of similar sets; their distance.
SURE, FAR = 64, 25


def fingerprint(text: bytes | None, shingle: int) -> int:
    """64-bit SimHash: a bit is 1 where over half of the shingle hashes have it (no words: 0)."""
    words = ascii_words(text.lower()) if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(texts: DataFrame, shingle: int, of_sets: bool) -> DataFrame:
    """(doc, hash, cls, n, fp) of texts (doc, hash, text): fingerprints of all shingles, which are
    the classes; or of the sets of distinct ones, whose classes and sizes (n) are given with them."""

    def rows():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            given = utf8(batch.column("text"))
            if of_sets:
                sets = [shingle_set(t, shingle) for t in given]
                prints, cls, n = map(majority, sets), map(set_class, sets), map(len, sets)
            else:
                prints, cls, n = [fingerprint(t, shingle) for t in given], None, [0] * len(given)
            fp = pa.array(np.array([*prints], np.uint64).view(np.int64))
            return record(
                doc=batch.column("doc"), hash=batch.column("hash"), cls=fp if cls is None else pa.array(cls, pa.int64()),
                n=pa.array(n, pa.int32()), fp=fp,
            )

        return f

    return per_document(texts, "doc long, hash long, cls long, n int, fp long", rows, "text")


def _keys(parts: int, distance: int) -> list[Column]:
    """A key for every choice of parts that must all be equal."""
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    masks = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(parts)]
    out = []
    for n, chosen in enumerate(combinations(masks, parts - distance)):
        mask = sum(chosen)
        mask -= (mask >> 63) << 64
        out.append(F.struct(F.lit(n).alias("n"), F.col("fp").bitwiseAND(F.lit(mask)).alias("bits")))
    return out


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def links_in_buckets(
    bucket: np.ndarray, side: np.ndarray, fp: np.ndarray, distance: int, size: np.ndarray | None = None, pos: np.ndarray | None = None
) -> np.ndarray:
    """Row pairs, a spanning forest of the links within each bucket (ids ascend).

    side 0 rows pair with all of their bucket where no row has side 1, else with side 1 only.
    With sizes and places of the shared shingle, links are pairs that may have Jaccard >= 4/5.
    """
    n = len(fp)
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int16)
    order = np.lexsort((table[:, 0], bucket))
    bucket, side, fp, table = bucket[order], side[order], fp[order], table[order]
    sure = np.ones(n, bool)
    if size is not None:
        size, pos = size[order].astype(np.int64), pos[order].astype(np.int64)
        sure = size >= SURE
    two_sided = np.zeros(n, bool)
    if n:
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        two_sided = np.repeat(np.maximum.reduceat(side, starts) > 0, np.diff(np.append(starts, n)))
    parent = np.arange(n)
    kept = []
    live, shift = np.arange(n), 0
    while len(live):
        shift += 1
        live = live[live + shift < n]
        other = live + shift
        same = bucket[live] == bucket[other]
        if size is None:  # rows are in order of the first coordinate: who is too far stays so
            same &= table[other, 0] - table[live, 0] <= distance
        live = live[same]
        x, y = live, live + shift
        facing = ~two_sided[x] | (side[x] != side[y])
        x, y = x[facing], y[facing]
        apart = parent[x] != parent[y]
        x, y = x[apart], y[apart]
        if size is not None:
            least = 4 * (size[x] + size[y])
            some = (9 * np.minimum(size[x] - pos[x], size[y] - pos[y]) >= least) & (9 * np.minimum(size[x], size[y]) >= least)
            x, y = x[some], y[some]
        for p in range(len(PIVOTS)):
            if not len(x):
                break
            close = (np.abs(table[x, p] - table[y, p]) <= distance) | ~(sure[x] & sure[y])
            x, y = x[close], y[close]
        linked = (np.bitwise_count(fp[x] ^ fp[y]) <= distance) | ~(sure[x] & sure[y])
        for a, b in zip(x[linked].tolist(), y[linked].tolist(), strict=True):
            ra, rb = a, b
            while parent[ra] != ra:
                ra = parent[ra]
            while parent[rb] != rb:
                rb = parent[rb]
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
                kept.append((order[a], order[b]))
        if linked.any():
            parent = _roots(parent)
    return np.array(kept, np.int64).reshape(-1, 2)


#: Rows that one step of a bucket task compares.
STEP_ROWS = 200_000


def _link_rows(distance: int, sized: bool):
    """Links (a, b) between class ids, from rows sorted by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(columns: list[np.ndarray]) -> pa.RecordBatch:
            bucket, side, rep, fp, n, pos = columns
            pairs = links_in_buckets(bucket, side, fp.view(np.uint64), distance, *((n, pos) if sized else ()))
            return record(a=pa.array(rep[pairs[:, 0]]), b=pa.array(rep[pairs[:, 1]]))

        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "side", "rep", "fp", "n", "pos")]
            held.append(cols)
            size += len(cols[0])
            if size >= STEP_ROWS:
                all_cols = [np.concatenate(c) for c in zip(*held, strict=True)]
                cut = int(np.argmax(all_cols[0] == all_cols[0][-1]))
                if cut:
                    yield linked([c[:cut] for c in all_cols])
                held, size = [[c[cut:] for c in all_cols]], size - cut
        if held:
            yield linked([np.concatenate(c) for c in zip(*held, strict=True)])

    return run


def keyed_parts(classes: DataFrame, distance: int, parts: int | None) -> DataFrame:
    """(key, rep, fp, n, pos): every class (rep, fp) under each choice of parts that must be equal."""
    if parts is None:
        n = classes.count()
        parts = next((p for p, most in ((distance + 1, 4e6), (distance + 2, 1e9)) if n < most), distance + 3)
    none = F.lit(0)
    return classes.select(F.explode(F.array(*_keys(parts, distance))).alias("key"), "rep", "fp", none.alias("n"), none.alias("pos"))


def near_links(keyed: DataFrame, distance: int, sized: bool = False, bucket_rows: int = 4096) -> DataFrame:
    """(a, b): links that connect all classes of one key (key, rep, fp, n, pos) within distance."""
    # below the bound a bucket cannot be too large, so the count finds only those above it
    sizes = keyed.groupBy("key").agg(F.count("*").alias("rows"))
    large = materialised(sizes.where(F.col("rows") > bucket_rows))
    half = max(1, bucket_rows // 2)
    kept = ["rep", "fp", "n", "pos"]
    if large.isEmpty():
        dealt = keyed.select(F.xxhash64("key").alias("bucket"), F.lit(0).alias("side"), *kept)
    else:
        cut = F.coalesce(F.ceil(F.col("rows") / half), F.lit(1)).cast("int")
        own = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("cut")).cast("int")
        dealt = (
            keyed.join(large, "key", "left").withColumn("cut", cut).withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
            .select(
                F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"),
                (F.col("own") > F.col("other")).cast("int").alias("side"), *kept,
            )
        )
    tasks = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        dealt.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(_link_rows(distance, sized), "a long, b long")
    )


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4,
    similarity: float | None = None, parts: int | None = None, bucket_rows: int = 4096,
) -> DataFrame:
    """(doc, hash, fp, grp, component): one row per row of docs; component is the smallest id
    reachable, grp a number of its own for every component, hash that of the text (xxhash64).

    Ids are integers. Null and wordless texts have fingerprint zero and link like any other (by
    similarity: with each other). A null id is no candidate for the smallest; a component of null
    ids only is null. Rows that share an id are separate rows of that id. similarity is 0.8 or none.
    """
    if similarity not in (None, 0.8):
        raise ValueError("similarity is 0.8 or none")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    rows = written(fingerprints(texts, shingle, similarity is not None))
    classes = materialised(rows.groupBy("cls").agg(F.min("doc").alias("low"), F.first("fp").alias("fp")))
    if similarity is None:
        keyed = keyed_parts(classes.select(F.col("cls").alias("rep"), "fp"), distance, parts)
        found = connected_components(near_links(keyed, distance, False, bucket_rows))
    else:
        sets, keyed = candidate_sets(texts, rows, shingle)
        found = similar_components(connected_components(near_links(keyed, FAR, True, bucket_rows)), sets)
    joined = found.select(F.col("node").alias("cls"), F.col("component").alias("grp"))
    rooted = materialised(classes.join(joined, "cls", "left").select("cls", "low", F.coalesce("grp", "cls").alias("grp")))
    lows = materialised(rooted.groupBy("grp").agg(F.min("low").alias("component")))
    labels = materialised(rooted.join(lows, "grp").select("cls", "grp", "component"))
    return rows.join(labels, "cls").select("doc", "hash", "fp", "grp", "component")
