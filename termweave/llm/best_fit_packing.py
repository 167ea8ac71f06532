"""Best-fit packing of tokenised documents by the sum-of-squares rule.

Tokens come from an existing tokenizer file. Documents longer than a sequence are cut so that only
the first piece is short; a full piece is a sequence of its own. The others are dealt into groups
by a hash, and each group is packed in one task: a piece goes where the sum over residual gaps of
the squared number of open bins with that gap becomes smallest (a new bin is one of the choices).
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialised, runs, with_outputs

#: White space in a row, from which on a text goes through the tokenizer itself.
WHITE_RUN = 100_000


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes, as the tokenizer file gives them.

    Where the same vocabulary stands beside the file as ranks (.tiktoken), texts are encoded with
    those, which takes a quarter of the time; a probe makes sure that the two agree. Texts that
    hold a special token's string, or white space in runs that the ranks' splitter may refuse, go
    through the tokenizer itself.
    """

    PROBE = "It's 12 o'clock\u2014r\u00e9sum\u00e9s, na\u00efve  \U0001f600 x_y!! 3.14"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.white = re.compile(rf"\s{{{WHITE_RUN}}}")
        self.fast = self._by_ranks(path.removesuffix(".json") + ".tiktoken") or self._ids
        if [list(x) for x in self.fast([self.PROBE])] != self._ids([self.PROBE]):
            raise ValueError(f"the ranks beside {path} are of another vocabulary")

    @staticmethod
    def _by_ranks(path: str):
        if not os.path.exists(path):
            return None
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        model = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: list(map(model.encode_ordinary, texts))

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _apart(self, text: str) -> bool:
        return any(s in text for s in self.special) or (len(text) >= WHITE_RUN and self.white.search(text) is not None)

    def ids(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if self._apart(t)]
        skip = set(whole)
        out: list = [None] * len(texts)
        plain = [i for i in range(len(texts)) if i not in skip]
        for some, encode in ((plain, self.fast), (whole, self._ids)):
            for i, found in zip(some, encode([texts[i] for i in some]), strict=True):
                out[i] = np.array(found, "<u4").tobytes()
        return out


PIECES = "array<struct<piece:int,start:long,length:int,ids_crc32:long>>"


def token_pieces(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
    end_id: int = 0, with_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]): the pieces of every row's tokens and end_id."""
    kind = [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())]
    kind += [("ids", pa.list_(pa.int32()))] * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def make():
        encoder = Encoder(tokenizer_path)  # a task's own: kept by idle workers, it would stand beside the next stages

        def f(texts):
            out = []
            for ids in encoder.ids([(t or b"").decode("utf-8", "replace") for t in texts]):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n, capacity), n]
                pieces = []
                for k in range(len(cuts) - 1):
                    part = ids[4 * cuts[k] : 4 * cuts[k + 1]]
                    row = {"piece": k, "start": cuts[k], "length": cuts[k + 1] - cuts[k], "ids_crc32": zlib.crc32(part)}
                    pieces.append(row | ({"ids": np.frombuffer(part, "<u4").tolist()} if with_ids else {}))
                out.append(pieces)
            return [pa.array(out, pa.list_(pa.struct(kind)))]

        return f

    ddl = PIECES.replace("long>>", "long,ids:array<int>>>") if with_ids else PIECES
    pieces = with_outputs(docs, [F.col(id_col)], F.col(text_col), {"__p": ddl}, make)
    return pieces.select(id_col, F.explode("__p").alias("__p")).select(id_col, "__p.*")


def sum_of_squares(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length, in the order given."""
    open_bins = np.zeros(capacity + 1, np.int64)
    stacks: dict[int, list[int]] = {}
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    made = 0
    none = np.int64(1) << 60
    for i, size in enumerate(lengths):
        gap, change = capacity, 2 * open_bins[capacity - size] + 1 if size < capacity else 0
        there = open_bins[size:capacity]
        if len(there):
            # the bin leaves its gap g (2 g's count - 1 less) and joins gap g - size (as much more)
            grown = 2 * open_bins[: capacity - size] + 1
            grown[0] = 0  # a filled bin is closed
            changes = np.where(there > 0, grown + 1 - 2 * there, none)
            k = int(changes.argmin())
            if changes[k] <= change and there[k] > 0:
                gap = size + k
        if gap == capacity:
            bins[i], made = made, made + 1
        else:
            bins[i] = stacks[gap].pop()
            open_bins[gap] -= 1
        offsets[i] = capacity - gap
        left = gap - size
        if left:
            stacks.setdefault(left, []).append(int(bins[i]))
            open_bins[left] += 1
    return bins, offsets


def _pack_rows(capacity: int, names: list[str]):
    """Rows of whole groups, sorted by group: each group is packed when it is complete."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "grp"):
            bins, offsets = sum_of_squares(table["length"].to_pylist(), capacity)
            out = table.select(names).append_column("sequence_id", pa.array((table["grp"][0].as_py() << 32) + bins))
            yield from out.append_column("offset", pa.array(offsets)).to_batches()

    return run


def best_fit_packing(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048,
    end_id: int = 0, group_rows: int = 16384, with_ids: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids], sequence_id, offset): every piece and its place.

    Null and empty texts are the end token alone. Rows that share an id, or repeat, are packed
    each. Sequence ids are unique, not dense. Groups of about group_rows pieces are dealt by hash
    and packed longest first, also where many rows are alike.
    """
    pieces = materialised(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id, with_ids))
    names = pieces.columns
    n = pieces.where(F.col("length") < capacity).count()
    groups = max(1, -(-n // group_rows))
    # the row number of the written table keeps rows that repeat, or have no id, out of one group
    grp = F.pmod(F.xxhash64(id_col, "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.withColumn("grp", grp).repartition(tasks, "grp")
    dealt = dealt.sortWithinPartitions("grp", F.desc("length"), id_col, "piece", "ids_crc32")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.mapInArrow(_pack_rows(capacity, names), f"{kinds}, sequence_id long, offset long")
