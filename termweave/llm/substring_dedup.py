"""Substring dedup: repeated word windows found in suffix trees that are partitioned by prefix.

Suffixes that can hold a repeat are split into groups by a prefix, each group is turned into the
upper ``window`` words of its suffix tree inside one task, and every internal node at that depth is
a repeat: the suffixes below it begin with the same window. Neighbouring windows below such nodes
join to the span of a maximal repeat.

* **Prefix.** Grouping every suffix by its own first words would send ``window`` words for each.
  So suffixes go by their anchor: of the suffixes that start within a window (and have ``stem``
  words in it) the one whose first ``stem`` words hash smallest. Equal windows have anchors with
  equal prefixes, and neighbouring windows mostly have one anchor in common, so that they travel
  together as one run of text under the ``stem``-word prefix of their anchor.
* **Tree.** A group's suffixes are sorted by their words (see suffix_order); between neighbours in
  that order that share fewer words than ``window`` one deep node ends and the next begins.
* **Variable length.** A prefix with more than ``group_words`` words of text, in however few
  documents, is too frequent for one task. Its suffixes are split by the first ``window`` words of
  each instead. Such a group is one internal node of the tree, however large, so only its smallest
  document is needed, which Spark aggregates map-side first. No length between would do: a window
  that ends before a longer prefix of its anchor does is not below it.
* **What never ships.** Prefixes of one document only cannot lie above a repeat. A bitmap of fixed
  size (``bitmap_bits`` at most) tells tasks which ones several documents share; where it errs,
  a group of one document is built in vain, and nothing else changes. Past a sixteenth as many
  shared prefixes as bits (4 million) it lets more and more through, in the end all text once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, bits_for, give_back, in_bitmap, materialised, per_document, record, steps, unclashed, utf8, written
from .wordhash import ascii_words, byte_values, gram_hashes, sliding_min, span_hashes, word_bounds

#: Two independent word hashes; a frequent window is named by both, 128 bits in all.
FIRST, SECOND = byte_values(1), byte_values(2)

#: Words that one task turns into suffix trees at a time.
TREE_WORDS = 600_000
#: Bytes of frequent repeats that may go to every task; more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def _window_stems(hashes: np.ndarray, window: int, stem: int) -> np.ndarray:
    """The stem (smallest gram hash) of every window."""
    return sliding_min(gram_hashes(hashes, stem), window - stem + 1)


def _runs(stems: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last window of every run of windows with one stem."""
    cuts = np.flatnonzero(stems[1:] != stems[:-1]) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(stems)]))


def _stem_rows(window: int, stem: int):
    def rows():
        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, stems, words = [], [], []
            for doc, text in zip(batch.column("doc").to_pylist(), utf8(batch.column("text")), strict=True):
                if doc is None or not text:
                    continue
                found = _window_stems(span_hashes(text, *word_bounds(text), FIRST), window, stem)
                if len(found):
                    begin, end = _runs(found)
                    some, which = np.unique(found[begin], return_inverse=True)
                    stems.append(some)
                    words.append(np.bincount(which, end - begin + window - 1).astype(np.int64))
                    ids.append(np.full(len(stems[-1]), doc, np.int64))
            empty = [np.empty(0, np.int64)]
            return record(
                stem=pa.array(np.concatenate(stems).view(np.int64) if stems else empty[0]),
                doc=pa.array(np.concatenate(ids or empty)),
                words=pa.array(np.concatenate(words or empty)),
            )

        return f

    return rows


_SUFFIX_SCHEMA = "stem long, deep1 long, deep2 long, doc long, start int, n int, words binary"


def _suffix_rows(window: int, stem: int, shared, frequent):
    """Runs of suffixes under shared stems; under a frequent stem, every suffix by its own window."""

    def rows():
        some, many = shared.value, frequent.value

        def f(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple] = []
            deep: list[tuple] = []
            for doc, text in zip(batch.column("doc").to_pylist(), utf8(batch.column("text")), strict=True):
                if doc is None or not text:
                    continue
                at, to = word_bounds(text)
                if len(at) < window:
                    continue
                hashes = span_hashes(text, at, to, FIRST)
                stems = _window_stems(hashes, window, stem)
                begin, end = _runs(stems)
                keep = in_bitmap(some, stems[begin])
                begin, end = begin[keep], end[keep]
                hot = in_bitmap(many, stems[begin])
                for b, e in zip(begin[~hot].tolist(), end[~hot].tolist(), strict=True):
                    out.append((stems[b], doc, b, e - b, text[at[b] : to[e + window - 2]]))
                if hot.any():
                    starts = np.concatenate([np.arange(b, e) for b, e in zip(begin[hot], end[hot], strict=True)])
                    d1 = gram_hashes(hashes, window)[starts].view(np.int64)
                    d2 = gram_hashes(span_hashes(text, at, to, SECOND), window)[starts].view(np.int64)
                    deep.append((d1, d2, np.full(len(starts), doc, np.int64), starts.astype(np.int32)))
            n_deep = sum(len(x[0]) for x in deep)
            cols = [np.concatenate(x) for x in zip(*deep, strict=True)] if deep else [np.empty(0, np.int64)] * 4
            pad = pa.nulls(n_deep, pa.int64())
            key, docs, start, n, text = zip(*out, strict=True) if out else ((),) * 5
            none = pa.nulls(len(out), pa.int64())
            return record(
                stem=pa.concat_arrays([pa.array(np.array(key, np.uint64).view(np.int64)), pad]),
                deep1=pa.concat_arrays([none, pa.array(cols[0])]),
                deep2=pa.concat_arrays([none, pa.array(cols[1])]),
                doc=pa.concat_arrays([pa.array(docs, pa.int64()), pa.array(cols[2])]),
                start=pa.concat_arrays([pa.array(start, pa.int32()), pa.array(cols[3].astype(np.int32))]),
                n=pa.concat_arrays([pa.array(n, pa.int32()), pa.nulls(n_deep, pa.int32())]),
                words=pa.concat_arrays([pa.array(text, pa.binary()), pa.nulls(n_deep, pa.binary())]),
            )

        return f

    return rows


def suffix_order(words: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by their first ``depth`` words, and how many of these each shares with
    the one before it in that order (0 for the first). Every suffix has so many words.

    Ranks of 1, 2, 4 ... words come each from two of half the length, and ``depth`` words are the
    sum of such lengths. Words are told apart and ordered by their hashes.
    """
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    ranks, width = [rank], 1
    while 2 * width <= depth:
        ahead = np.zeros_like(rank)
        ahead[: max(0, len(rank) - width)] = rank[width:]
        rank = np.unique(rank * (len(rank) + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        ranks.append(rank)
        width *= 2
    keys, at = [], starts
    for level in reversed(range(len(ranks))):
        if depth >> level & 1:
            keys.append(ranks[level][at])
            at = at + (1 << level)
    order = np.lexsort(keys[::-1])
    x, y = starts[order[:-1]], starts[order[1:]]
    shared = np.zeros(len(starts), np.int64)
    for level in reversed(range(len(ranks))):
        step = 1 << level
        live = np.flatnonzero(shared[1:] + step <= depth)
        done = shared[1:][live]
        shared[1:][live] += step * (ranks[level][x[live] + done] == ranks[level][y[live] + done])
    return order, shared


def _deep_nodes(words: np.ndarray, starts: np.ndarray, docs: np.ndarray, window: int) -> np.ndarray:
    """The smallest document below the deep node of every suffix (a leaf is a node of its own)."""
    order, shared = suffix_order(words, starts, window)
    begins = shared < window
    smallest = np.minimum.reduceat(docs[order], np.flatnonzero(begins))[np.cumsum(begins) - 1]
    out = np.empty_like(docs)
    out[order] = smallest
    return out


def _subtree_rows(window: int):
    """Removed word spans, from rows that are sorted by stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(rows: list[tuple]) -> pa.RecordBatch:
            text = b" ".join(r[4] for r in rows)
            hashes = span_hashes(text, *word_bounds(text), FIRST)
            n = np.array([r[3] for r in rows], np.int64)
            base = np.cumsum(n + window - 1) - (n + window - 1)
            row = np.repeat(np.arange(len(rows)), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            docs = np.array([r[1] for r in rows], np.int64)[row]
            hit = _deep_nodes(hashes, base[row] + within, docs, window) < docs
            start = np.array([r[2] for r in rows], np.int64)[row] + within
            # neighbouring repeated windows of a run become one span
            begin = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1] & (row[1:] == row[:-1]))))
            last = np.flatnonzero(hit & ~np.concatenate((hit[1:] & (row[1:] == row[:-1]), [False])))
            return record(
                doc=pa.array(docs[begin]),
                start=pa.array(start[begin].astype(np.int32)),
                end=pa.array((start[last] + window).astype(np.int32)),
            )

        held: list[tuple] = []
        size, bound = 0, TREE_WORDS
        for batch in steps(batches, "words"):
            names = ("stem", "doc", "start", "n", "words")
            for r in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if size >= bound and held and r[0] != held[-1][0]:
                    yield tree(held)
                    held, size = [], 0
                held.append(r)
                size += r[3] + window
        if held:
            yield tree(held)
        held.clear()
        give_back()

    return run


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, stem: int = 20,
    group_words: int = 40_000, bitmap_bits: int = 1 << 26,
) -> DataFrame:
    """(doc, start, end): word spans covered by windows that also start in a smaller document.

    Ids are integers. Null ids and null or short texts give no span; rows that share an id are one document, so a
    repeat between them, or within a document, gives none.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    stems = per_document(texts, "stem long, doc long, words long", _stem_rows(window, stem), "text")
    shared = materialised(
        stems.groupBy("stem")
        .agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.sum("words").alias("n"))
        .where("low < high")
        .select("stem", (F.col("n") > group_words).alias("frequent"))
    )
    n = shared.count()
    bits = bits_for(n, bitmap_bits)
    some = spark.sparkContext.broadcast(bitmap(shared, "stem", bits))
    many = spark.sparkContext.broadcast(bitmap(shared.where("frequent"), "stem", bits))
    suffixes = written(per_document(texts, _SUFFIX_SCHEMA, _suffix_rows(window, stem, some, many), "text"))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spans = (
        suffixes.where("stem is not null")
        .select("stem", "doc", "start", "n", "words")
        .repartition(int(parts), "stem")
        .sortWithinPartitions("stem")
        .mapInArrow(_subtree_rows(window), "doc long, start int, end int")
    )
    deep = suffixes.where("stem is null").select("deep1", "deep2", "doc", "start")
    nodes = materialised(
        deep.groupBy("deep1", "deep2").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high")
    )
    if nodes.count() * 32 <= BROADCAST_BYTES:
        nodes = F.broadcast(nodes)
    deep_spans = (
        deep.join(nodes, ["deep1", "deep2"])
        .where("low < doc")
        .select("doc", "start", (F.col("start") + window).alias("end"))
    )
    return spans.unionByName(deep_spans)


def _cut_rows():
    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept = [], [], []
        for text, spans in zip(utf8(batch.column("__text")), batch.column("__spans").to_pylist(), strict=True):
            words = ascii_words(text)
            n_words.append(len(words))
            if spans:
                edge = np.zeros(len(words) + 1, np.int64)
                for s in spans:
                    if s["end"] <= len(words):
                        edge[s["start"]] += 1
                        edge[s["end"]] -= 1
                stays = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
                words = [words[i] for i in stays]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        given = [batch.column(i) for i in range(batch.num_columns - 2)]
        names = batch.schema.names[:-2] + ["kept_text", "n_words", "n_removed"]
        new = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
        return pa.RecordBatch.from_arrays(given + new, names=names)

    return f


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), **options
) -> DataFrame:
    """One row per row of docs: id, the carried columns, kept_text, n_words, n_removed.

    kept_text is the words not covered by a repeated window, joined by one space ("" for a null
    or empty text). carry names columns of docs to hand through; it may not name an output.
    """
    unclashed(id_col, carry, ("kept_text", "n_words", "n_removed"))
    spans = repeated_spans(docs, id_col, text_col, **options)
    by_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("__spans"))
    rows = docs.select(F.col(id_col).alias("__id"), *[F.col(c) for c in carry], F.col(text_col).alias("__text"))
    joined = rows.join(by_doc, F.col("__id").cast("long") == F.col("doc"), "left").select(
        F.col("__id").alias(id_col), *[F.col(c) for c in carry], "__text", "__spans"
    )
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-2])
    return per_document(joined, f"{kinds}, kept_text string, n_words long, n_removed long", _cut_rows, "__text")
