"""What the operators of this subpackage share: the shared folder, folds, and Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, written  # noqa: F401

#: Bytes of text that one step of a task holds as Python objects.
STEP_BYTES = 1 << 20


def materialised(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder; its lineage ends there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fold(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether the row belongs to the held-out fold; false for a null id."""
    return F.coalesce(fold(id_col, modulus) == remainder, F.lit(False))


def utf8(column: pa.Array) -> list[bytes | None]:
    """The texts of an Arrow column as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


def steps(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices of about STEP_BYTES of text (one row at least)."""
    for batch in batches:
        n = batch.num_rows
        rows = max(1, n * STEP_BYTES // max(1, batch.column(text).nbytes)) if n else 1
        for at in range(0, n, rows):
            yield batch.slice(at, rows)


def give_back() -> None:
    """Return a task's freed memory to the system: idle workers live on beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def per_document(
    df: DataFrame, schema: str, rows: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], text: str
) -> DataFrame:
    """mapInArrow with a function that each task builds once (its caches live as long as the task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = rows()
        for batch in steps(batches, text):
            yield f(batch)
        del f
        give_back()

    return df.mapInArrow(run, schema)


def record(**columns) -> pa.RecordBatch:
    """A record batch of named Arrow arrays."""
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def with_outputs(docs: DataFrame, keep: list[Column], text: Column, outputs: dict[str, str], make: Callable) -> DataFrame:
    """The columns ``keep`` and, for each row, what a function of the texts gives.

    make() is called once in each task and returns that function: from a list of UTF-8 texts
    (None for null) to one Arrow array for each of outputs (name -> Spark type).
    """
    rows = docs.select(*keep, text.alias("__text"))
    kept = rows.schema.fields[:-1]

    def build():
        f = make()

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            given = [batch.column(i) for i in range(len(kept))]
            return pa.RecordBatch.from_arrays(
                given + f(utf8(batch.column("__text"))), names=[k.name for k in kept] + list(outputs)
            )

        return run

    kinds = [f"`{k.name}` {k.dataType.simpleString()}" for k in kept] + [f"`{n}` {t}" for n, t in outputs.items()]
    return per_document(rows, ", ".join(kinds), build, "__text")


def unclashed(id_col: str, carry: tuple[str, ...], outputs: tuple[str, ...]) -> None:
    """An error that names them where the id or carried columns have the name of an output, or of one another."""
    given = [c.lower() for c in (id_col, *carry)]
    taken = sorted({c for c in given if given.count(c) > 1 or c in {o.lower() for o in outputs}})
    if taken:
        raise ValueError(f"carried columns must have other names than the id and the outputs: {', '.join(taken)}")


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole runs of rows with an equal key, from batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(key).to_numpy()
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(values)], strict=True):
            if b > a:
                part = batch.slice(a, b - a)
                if held and held[-1].column(key)[0] != part.column(key)[0]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def bits_for(n: int, most: int = 1 << 27) -> int:
    """Bits of a bitmap for n values: 16 to 32 each, ``most`` at most."""
    return min(most, max(1024, 1 << (16 * n).bit_length()))


def bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bit for every value of a long column (its low bits), gathered as at most bits/64 words."""
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    words = (
        df.select(F.shiftright(at, 6).cast("int").alias("word"), at.bitwiseAND(F.lit(63)).alias("bit"))
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(1L, cast(bit as int)))").alias("bits"))
        .toArrow()
    )
    out = np.zeros(max(1, bits // 64), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the unsigned values may be in the bitmap; those that are always may."""
    at = values & np.uint64(len(bits) * 64 - 1)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def may_be_in(values: Column, df: DataFrame, column: str) -> Column:
    """Whether a long is, or by the bitmap may be, among the values of df's column."""
    shared = df.sparkSession.sparkContext.broadcast(bitmap(df, column, bits_for(4 * df.count())))

    @F.pandas_udf("boolean")
    def among(x: pd.Series) -> pd.Series:
        return pd.Series(in_bitmap(shared.value, x.to_numpy(np.int64).view(np.uint64)))

    return among(values)
