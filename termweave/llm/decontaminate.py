"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The test strings are the word windows of the benchmark items. For each window length, a shift
table over blocks of two words says how far the search may jump, so most positions are never
looked at; where the shift is zero, the bucket of the block as a suffix selects the test strings,
and these are compared word by word. One task searches many stretches of its documents at a time.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import may_be_in, unclashed, with_outputs, written
from .wordhash import byte_values, span_hashes, word_bounds

#: Bytes that are in no word: fixed values, the class [\x00-\x2F\x3A-\x60\x7B-\x7F].
OUTSIDE = np.zeros(256, bool)
OUTSIDE[0x00:0x30] = OUTSIDE[0x3A:0x61] = OUTSIDE[0x7B:0x80] = True
VALUES = byte_values(5)
#: Stretches of words that a task searches side by side.
LANES = 4096


def item_words(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a text, A-Z lower-cased."""
    if not text:
        return np.empty(0, np.uint64)
    low = text.lower()
    return span_hashes(low, *word_bounds(low, OUTSIDE), VALUES)


@dataclass
class Patterns:
    """Test strings of one length as word numbers (0: a word of no test string), with their tables."""

    strings: np.ndarray
    vocabulary: int
    blocks: np.ndarray
    shifts: np.ndarray
    suffixes: np.ndarray

    @staticmethod
    def of(strings: np.ndarray, vocabulary: int) -> Patterns:
        """strings: distinct rows, sorted here by their suffix block."""
        length = strings.shape[1]
        block = min(2, length)
        codes = [Patterns.code(strings, at, vocabulary) for at in range(block - 1, length)]
        order = np.argsort(codes[-1], kind="stable")
        flat = np.concatenate(codes)
        shift = np.repeat(length - 1 - np.arange(block - 1, length), len(strings))
        by = np.lexsort((shift, flat))
        blocks, first = np.unique(flat[by], return_index=True)
        return Patterns(strings[order], vocabulary, blocks, shift[by][first], codes[-1][order])

    @staticmethod
    def code(words: np.ndarray, at, vocabulary: int) -> np.ndarray:
        """The block that ends at column ``at`` of each row (or at each index of a flat array)."""
        if words.ndim == 1:
            return words[at - 1] * (vocabulary + 1) + words[at]
        return words[:, at - 1] * (vocabulary + 1) + words[:, at] if at else words[:, 0].copy()

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end position, string number) of every occurrence."""
        length, n = self.strings.shape[1], len(words)
        if n < length:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lane = max(64, -(-n // LANES))
        at = np.arange(0, n, lane)
        stop = np.minimum(at + lane, n)
        at = np.maximum(at, length - 1)
        default = length - min(2, length) + 1
        found = []
        while True:
            live = at < stop
            at, stop = at[live], stop[live]
            if not len(at):
                break
            code = self.code(words, at, self.vocabulary) if length > 1 else words[at]
            slot = np.minimum(np.searchsorted(self.blocks, code), len(self.blocks) - 1)
            shift = np.where(self.blocks[slot] == code, self.shifts[slot], default)
            found.append(at[shift == 0])
            at = at + np.maximum(shift, 1)
        ends = np.sort(np.concatenate(found))
        code = self.code(words, ends, self.vocabulary) if length > 1 else words[ends]
        low = np.searchsorted(self.suffixes, code, "left")
        many = np.searchsorted(self.suffixes, code, "right") - low
        out_e, out_s = [], []
        for begin, end in _pieces(many, 1 << 18):  # buckets are opened a bounded number of strings at a time
            m = many[begin:end]
            e = np.repeat(ends[begin:end], m)
            s = np.repeat(low[begin:end], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            for back in range(length - 1, -1, -1):
                same = words[e - back] == self.strings[s, length - 1 - back]
                e, s = e[same], s[same]
            out_e.append(e)
            out_s.append(s)
        return np.concatenate(out_e or [np.empty(0, np.int64)]), np.concatenate(out_s or [np.empty(0, np.int64)])


def _pieces(sizes: np.ndarray, most: int):
    """Index ranges whose sizes sum to about ``most``."""
    if len(sizes):
        group = (np.cumsum(sizes) - sizes) // most
        cuts = np.flatnonzero(np.diff(group)) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)], strict=True)


@dataclass
class Searcher:
    """All test strings of a block of items."""

    vocabulary: np.ndarray
    lengths: list[tuple[Patterns, np.ndarray, np.ndarray]]  # with the items of each string
    names: list[str | None]

    @staticmethod
    def of(items: list[tuple[str | None, bytes | None]], window: int) -> Searcher:
        names = sorted({i for i, _ in items if i is not None})
        number = {name: k for k, name in enumerate(names)}
        words = [item_words(t) for _, t in items]
        vocabulary = np.unique(np.concatenate([*words, np.empty(0, np.uint64)]))
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for (name, _), w in zip(items, words, strict=True):
            if len(w):
                rows = np.lib.stride_tricks.sliding_window_view(w, min(window, len(w)))
                by_length.setdefault(rows.shape[1], []).append((rows, number.get(name, -1)))
        lengths = []
        for _, parts in sorted(by_length.items()):
            rows = np.concatenate([r for r, _ in parts])
            owner = np.concatenate([np.full(len(r), k) for r, k in parts])
            numbers = np.searchsorted(vocabulary, rows) + 1
            strings, back = np.unique(numbers, axis=0, return_inverse=True)
            patterns = Patterns.of(strings, len(vocabulary))
            rank = np.empty(len(strings), np.int64)
            rank[np.lexsort(patterns.strings.T[::-1])] = np.arange(len(strings))
            place = np.empty(len(strings), np.int64)
            place[rank] = np.arange(len(strings))  # sorted strings -> their place by suffix
            pairs = np.unique(np.stack([place[back.ravel()], owner], 1), axis=0)
            first = np.searchsorted(pairs[:, 0], np.arange(len(strings) + 1))
            lengths.append((patterns, first, pairs[:, 1]))
        return Searcher(vocabulary, lengths, names)

    def find(self, texts: list[bytes | None]) -> list[tuple[int, np.ndarray, list[str]]]:
        """For each text its number of words, a mask of the hit ones, and the items found."""
        hashes = [item_words(t) for t in texts]
        n = np.array([len(h) for h in hashes], np.int64)
        base = np.cumsum(n + 1) - n  # a 0 stands before each text, so that no string spans two
        words = np.zeros(int((n + 1).sum()), np.int64)
        if len(self.vocabulary):
            flat = np.concatenate(hashes)
            slot = np.minimum(np.searchsorted(self.vocabulary, flat), len(self.vocabulary) - 1)
            inside = np.arange(n.sum()) + np.repeat(np.arange(1, len(n) + 1), n)
            words[inside] = np.where(self.vocabulary[slot] == flat, slot + 1, 0)
        edge = np.zeros(len(words) + 1, np.int64)
        doc_item = [np.empty((0, 2), np.int64)]
        for patterns, first, owner in self.lengths:
            ends, strings = patterns.search(words)
            np.add.at(edge, ends - patterns.strings.shape[1] + 1, 1)
            np.add.at(edge, ends + 1, -1)
            if len(ends):
                pairs = np.unique(np.stack([np.searchsorted(base, ends, "right") - 1, strings], 1), axis=0)
                m = first[pairs[:, 1] + 1] - first[pairs[:, 1]]
                at = np.repeat(first[pairs[:, 1]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                doc_item.append(np.stack([np.repeat(pairs[:, 0], m), owner[at]], 1))
        hit = np.cumsum(edge[:-1]) > 0
        found = np.unique(np.concatenate(doc_item), axis=0)
        found = found[found[:, 1] >= 0]
        cut = np.searchsorted(found[:, 0], np.arange(len(n) + 1))
        return [
            (int(n[i]), hit[base[i] : base[i] + n[i]], [self.names[k] for k in found[cut[i] : cut[i + 1], 1]])
            for i in range(len(n))
        ]


def _spans(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


SPANS = "array<struct<start:int,end:int>>"


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 10, block_bytes: int = 4 << 20, carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of docs: id, the carried columns, n_words, n_hit, items, hit_spans.

    items is the array of item ids (as strings, sorted) of which a window occurs; hit_spans the
    word spans inside occurrences. Null or wordless texts hit nothing; items without words match
    nothing; an item with a null id hits words but is in no list; rows that share an item id are
    one item. The benchmark is searched in blocks of about block_bytes of text, a bound on what the
    driver builds and a task holds: each block but the last is a job of its own that writes what it
    finds, a row a text that is hit. carry may not name an output.
    """
    unclashed(id_col, carry, ("n_words", "n_hit", "items", "hit_spans"))
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    if blocks > 1:
        items = written(items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks))))
    keep = [F.col(id_col), *[F.col(c) for c in carry]]
    text = F.col(text_col)

    def searched(rows: DataFrame, keep: list, text, number: int):
        part = items.where(F.col("block") == number) if blocks > 1 else items
        pairs = [(r["item"], r["text"].encode() if r["text"] is not None else None) for r in part.collect()]
        searcher = spark.sparkContext.broadcast(Searcher.of(pairs, window))

        def make():
            def f(texts):
                found = searcher.value.find(texts)
                spans = [[{"start": a, "end": b} for a, b in _spans(mask)] for _, mask, _ in found]
                kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
                return [
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array([list(names) for _, _, names in found], pa.list_(pa.string())),
                    pa.array(spans, kind),
                ]

            return f

        return with_outputs(rows, keep, text, {"__n": "long", "__i": "array<string>", "__s": SPANS}, make), searcher

    hashes = [F.xxhash64(text).alias("__h"), F.xxhash64(text, F.lit(1)).alias("__g")]
    earlier = []
    for number in range(blocks - 1):
        found, searcher = searched(docs, hashes, text, number)
        earlier.append(written(found.where(F.size("__s") > 0).select("__h", "__g", "__i", "__s").dropDuplicates(["__h", "__g"])))
        searcher.unpersist()
    out, _ = searched(docs, keep + (hashes if earlier else []), text, blocks - 1)
    items_, spans = F.col("__i"), F.col("__s")
    if earlier:
        before = reduce(DataFrame.unionByName, earlier).groupBy("__h", "__g").agg(
            F.flatten(F.collect_list("__i")).alias("__bi"), F.flatten(F.collect_list("__s")).alias("__bs")
        )
        before = written(before)
        # texts that no earlier block hit stay out of the join, by a bitmap
        named = may_be_in(F.col("__h"), before, "__h")
        none = [F.lit(None).cast(t).alias(c) for c, t in (("__bi", "array<string>"), ("__bs", SPANS))]
        out = out.withColumn("__named", named)
        met = out.where("__named").join(before, ["__h", "__g"], "left")
        out = met.unionByName(out.where("not __named").select("*", *none))
        both = [F.flatten(F.array(F.col(c), F.coalesce(b, F.array()))) for c, b in (("__i", "__bi"), ("__s", "__bs"))]
        out, items_ = out.withColumn("__all", F.array_sort(both[1])), both[0]
        # spans of several blocks may overlap: merged from left to right
        spans = F.expr(
            """aggregate(__all, cast(array() as array<struct<start:int,end:int>>), (a, x) ->
               case when size(a) > 0 and element_at(a, -1).end >= x.start
                    then concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start,
                         'end', greatest(element_at(a, -1).end, x.end))))
                    else concat(a, array(x)) end)"""
        )
    ids = F.array_sort(F.array_distinct(items_))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return (
        out.select(*keep, F.col("__n").alias("n_words"), ids.alias("items"), spans.alias("hit_spans"))
        .select(*keep, "n_words", n_hit.alias("n_hit"), "items", "hit_spans")
    )
