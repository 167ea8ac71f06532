"""Links by the exact similarity of shingle sets: helpers of the SimHash operator.

Two sets of n and m shingles with Jaccard >= 4/5 share c >= 4/9 (n + m) of them; with c <= n, m
this gives 4/5 <= n / m <= 5/4, and at most n/5 (or m/5) shingles of a set are not in the other.
Three steps use that, each on what the one before left:

* **Some.** Of a set's n//4 + 1 smallest hashes, more than n/25 are also among those of its partner
  (of the two sets take the one whose part ends first: at most a fifth of its shingles is missing).
* **All.** At least 4/5 of a set's shingles are in other sets that are left. How many sets have a
  shingle is counted here too; an order of shingles that puts frequent ones last follows from it.
* **Prefix.** In that order the first shingle that two sets share, at places i and j, has
  min(n - i, m - j) >= 4/9 (n + m), so it is among the first n//5 + 1 of either.

Every step needs what each similar pair has, so none loses a link; the frequent ones among the
shingles only set the cost, as any common order gives the same links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, may_be_in, per_document, record, runs, steps, utf8, written
from .components import connected_components
from .wordhash import byte_values, gram_hashes, span_hashes, word_bounds

VALUES = byte_values(21)
#: Classes that a task remembers, not to pass on a copy's shingles again.
SEEN = 200_000
#: Sets that make a shingle frequent, and how many frequent shingles go to every task at most.
FREQUENT, MOST_FREQUENT = 64, 1 << 20
#: Sets and shingles of one side of a comparison task.
SIDE_ROWS, SIDE_SHINGLES = 1024, 1 << 21


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """Sorted distinct hashes of every ``shingle`` consecutive words; a shorter text is one shingle."""
    if not text:
        return np.empty(0, np.uint64)
    low = text.lower()
    words = span_hashes(low, *word_bounds(low), VALUES)
    return np.unique(gram_hashes(words, min(shingle, max(1, len(words)))))


def set_class(shingles: np.ndarray) -> int:
    """A number that is equal where the sets are."""
    return int(np.array(xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), 7), np.uint64).view(np.int64))


def _token_rows(texts: DataFrame, shingle: int, share: int) -> DataFrame:
    """(token, cls): the n // share + 1 smallest shingles of every set, once a class and task or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in steps(batches, "text"):
            tokens, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for text in utf8(batch.column("text")):
                found = shingle_set(text, shingle)
                cls = set_class(found)
                if not len(found) or cls in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(cls)
                tokens.append(found[: len(found) // share + 1])
                owners.append(np.full(len(tokens[-1]), cls))
            yield record(token=pa.array(np.concatenate(tokens).view(np.int64)), cls=pa.array(np.concatenate(owners)))
        seen.clear()
        give_back()

    return texts.select("text").mapInArrow(run, "token long, cls long")


def _shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by token and class: (cls, n) counts of its tokens that other classes have;
    (token, df) of frequent tokens. Only the last row is held, however many have one token."""

    def rows(cls: np.ndarray, tokens: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        cls, n = np.unique(cls, return_counts=True)
        none, pad = pa.nulls(len(tokens), pa.int64()), pa.nulls(len(cls), pa.int64())
        return record(
            cls=pa.concat_arrays([pa.array(cls), none]), n=pa.concat_arrays([pa.array(n), none]),
            token=pa.concat_arrays([pad, pa.array(tokens)]), df=pa.concat_arrays([pad, pa.array(df)]),
        )

    last: tuple[int, int, int] | None = None
    for batch in batches:
        token, cls = batch.column("token").to_numpy(), batch.column("cls").to_numpy()
        before = 0
        if last is not None:
            token, cls, before = np.append(last[0], token), np.append(last[1], cls), last[2] - 1
        if not len(token):
            continue
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])))
        token, cls = token[new], cls[new]
        head = np.concatenate(([True], token[1:] != token[:-1]))
        at = np.arange(len(token))
        place = at - np.maximum.accumulate(np.where(head, at, 0)) + 1
        place[: int(np.argmax(head[1:])) + 1 if head[1:].any() else len(place)] += before
        ends = np.flatnonzero(head[1:])
        many = ends[place[ends] > FREQUENT]
        shared = (place[:-1] > 1) | ~head[1:]
        yield rows(cls[:-1][shared], token[many], place[many])
        last = int(token[-1]), int(cls[-1]), int(place[-1])
    if last is not None:
        some, none = np.array([last[1]]), np.empty(0, np.int64)
        frequent = last[2] > FREQUENT
        yield rows(some if last[2] > 1 else none, np.array([last[0]]) if frequent else none, np.array([last[2]]) if frequent else none)
    give_back()


def _shared(tokens: DataFrame) -> DataFrame:
    tasks = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = tokens.repartition(tasks, "token").sortWithinPartitions("token", "cls")
    return written(dealt.mapInArrow(_shared_rows, "cls long, n long, token long, df long"))


def _texts_of(texts: DataFrame, classes: DataFrame, shared: DataFrame, enough: str) -> DataFrame:
    """Texts of every class whose number s of shared shingles is enough for its n.

    A bitmap of the texts' hashes takes the place of a join, which would shuffle all texts. What it
    lets through beside them only costs: other sets are candidates in vain. It has 2**27 bits at
    most; past as many classes, the next step sees all texts.
    """
    counts = shared.where("cls is not null").groupBy("cls").agg(F.sum("n").alias("s"))
    left = written(classes.join(counts, "cls").where(enough).select("hash"))
    return texts.where(may_be_in(F.col("hash"), left, "hash"))


def _frequent(shared: DataFrame) -> np.ndarray:
    """Sorted frequent tokens: as many of the most frequent as MOST_FREQUENT allows."""
    found = shared.where("token is not null").select("token", "df")
    by_size = found.groupBy(F.floor(F.log2("df") * 4).alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect()
    kept, least = 0, None
    for r in by_size:
        kept += r["n"]
        if kept > MOST_FREQUENT:
            break
        least = r["size"]
    if least is None:
        return np.empty(0, np.uint64)
    tokens = found.where(F.floor(F.log2("df") * 4) >= least).select("token").toArrow()["token"].to_numpy()
    return np.sort(tokens.view(np.uint64))


def candidate_sets(texts: DataFrame, rows: DataFrame, shingle: int) -> tuple[DataFrame, DataFrame]:
    """What similar pairs can consist of: (cls, n, shingles), a row a class; and its prefix rows
    (key, rep, fp, n, pos). texts has doc, hash, text; rows has doc, hash, cls, n, fp."""
    classes = rows.where("n > 0").groupBy("cls").agg(F.max("n").alias("n"), F.min("hash").alias("hash"))
    some = _shared(_token_rows(texts, shingle, 4))
    left = _texts_of(texts, classes, some, "s * 25 > n")
    most = _shared(_token_rows(left, shingle, 1))
    left = _texts_of(texts, classes, most, "s * 5 >= n * 4")

    def make_sets():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, shingle) for t in utf8(batch.column("text"))]
            offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            values = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            return record(
                cls=pa.array([*map(set_class, sets)], pa.int64()), n=pa.array([*map(len, sets)], pa.int32()),
                shingles=pa.ListArray.from_arrays(offsets, values),
            )

        return f

    sets = per_document(left.select("text"), "cls long, n int, shingles array<long>", make_sets, "text")
    prints = rows.groupBy("cls").agg(F.first("fp").alias("fp"))
    sets = written(sets.dropDuplicates(["cls"]).join(prints, "cls"))
    late = texts.sparkSession.sparkContext.broadcast(_frequent(most))

    def prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "shingles"):
            n = batch.column("n").to_numpy()
            parts = []
            for s in batch.column("shingles"):
                s = np.asarray(s.values).view(np.uint64)
                at = np.minimum(np.searchsorted(late.value, s), max(0, len(late.value) - 1))
                often = late.value[at] == s if len(late.value) else np.zeros(len(s), bool)
                parts.append(np.concatenate([s[~often], s[often]])[: len(s) // 5 + 1])
            size = np.array([len(p) for p in parts], np.int64)
            yield record(
                key=pa.array(np.concatenate([*parts, np.empty(0, np.uint64)]).view(np.int64)),
                rep=pa.array(np.repeat(batch.column("cls").to_numpy(), size)), fp=pa.array(np.repeat(batch.column("fp").to_numpy(), size)),
                n=pa.array(np.repeat(n, size)), pos=pa.array(np.concatenate([*map(np.arange, size), np.empty(0)]).astype(np.int32)),
            )
        give_back()

    prefixes = sets.select("cls", "n", "fp", "shingles").mapInArrow(prefix_rows, "key long, rep long, fp long, n int, pos int")
    return sets, prefixes


def set_links(sets: list[np.ndarray], side: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with Jaccard >= 4/5: of all rows, or where a row has side 1
    between the sides. Overlaps are counted through the lists of the rows that have a shingle."""
    g, two = len(sets), bool(side.any())
    size = np.array([len(s) for s in sets], np.int64)
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(g), size)
    target = np.flatnonzero(side[owner] == 1) if two else np.arange(len(owner))
    by = target[np.argsort(token[target], kind="stable")]
    posting = owner[by]
    first = np.concatenate(([0], np.cumsum(np.bincount(token[by], minlength=int(token.max(initial=-1)) + 1))))
    start = np.cumsum(size) - size
    root, found = np.arange(g), []
    for x in np.flatnonzero(side == 0).tolist():
        t = token[start[x] : start[x] + size[x]]
        many = first[t + 1] - first[t]
        at = np.repeat(first[t] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        overlap = np.bincount(posting[at], minlength=g)
        near = np.flatnonzero((9 * overlap >= 4 * (size[x] + size)) & (root != root[x]))
        for r, k in zip(*np.unique(root[near], return_index=True), strict=True):
            found.append((x, int(near[k])))
            root[root == r] = root[x]
        if (root == root[0]).all():
            break
    return found


def _family_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b, whole) within every cell, from rows sorted by cell."""
    for table in runs(batches, "cell"):
        cls = table["cls"].to_numpy()
        sets = [np.asarray(s.values) for s in table["shingles"]]
        pairs = np.array(set_links(sets, table["side"].to_numpy()), np.int64).reshape(-1, 2)
        a, b = cls[pairs[:, 0]], cls[pairs[:, 1]]
        whole = table["whole"][0].as_py()
        if whole:  # all of the family is here, so its links can point to the smallest class of their component
            low = {int(c): int(c) for c in np.unique(np.concatenate([a, b]))}
            for _ in range(len(low)):
                before = dict(low)
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    low[x] = low[y] = min(low[x], low[y])
                if low == before:
                    break
            a, b = (np.array(c, np.int64) for c in ([*low], [*low.values()]))
        yield record(a=pa.array(a), b=pa.array(b), whole=pa.array([whole] * len(a), pa.bool_()))


def similar_components(families: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component): the smallest class reachable by pairs with Jaccard >= 4/5, for the classes
    of families (node, component) that have such a pair.

    A family is compared in one task, each set sent once; one over SIDE_ROWS sets or SIDE_SHINGLES
    shingles is cut into sides, and every pair of sides is a task of its own.
    """
    members = families.select(F.col("node").alias("cls"), F.col("component").alias("family")).join(sets.select("cls", "n"), "cls")
    cut = F.greatest(F.ceil(F.count("*") / SIDE_ROWS), F.ceil(F.sum("n") / SIDE_SHINGLES)).cast("int")
    cuts = members.groupBy("family").agg(cut.alias("cut"))
    own = F.pmod(F.xxhash64("cls", F.lit(3)), F.col("cut")).cast("int")
    dealt = (
        members.join(cuts, "family").select("cls", "family", "cut", own.alias("own"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
        .select(
            "cls", F.xxhash64("family", F.least("own", "other"), F.greatest("own", "other")).alias("cell"),
            (F.col("own") > F.col("other")).cast("int").alias("side"), (F.col("cut") == 1).alias("whole"),
        )
    )
    tasks = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filled = dealt.join(sets.select("cls", "shingles"), "cls").repartition(tasks, "cell").sortWithinPartitions("cell")
    links = written(filled.mapInArrow(_family_rows, "a long, b long, whole boolean"))
    done = links.where("whole").select(F.col("a").alias("node"), F.col("b").alias("component"))
    apart = links.where("not whole")
    return done if apart.isEmpty() else done.unionByName(connected_components(apart.select("a", "b")))
