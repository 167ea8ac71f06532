"""Vector codes: product quantisation by exact integer rounds, with norm-of-sum bounds.

Vectors are cut into equal parts, and each part position has a codebook. A round assigns every part
to its nearest entry and moves the entries to their parts' mean. The history of the codebooks is
kept, and a part keeps a lower bound of its distance to each group of entries, with the round in which
the bound was taken. In a later round that bound falls by the group's largest *net* displacement since
then, the norm of the sum of its moves, not by the sum of the norms round after round; groups whose
bound still exceeds the distance to the part's own entry are not looked at. Others are rescanned with
exact integer distances, so the result is that of a full scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, materialised, record, written

#: Components beyond this would not leave squared distances exact in 64 bits.
LARGEST = 1 << 24
#: Vectors that a step of a task holds at once, and bytes of a batch's distances.
STEP = 2048
_NONE = np.iinfo(np.int64).max


def entry_groups(book: np.ndarray, groups: int) -> np.ndarray:
    """(parts, entries): for each part position its entries in groups of near ones (farthest-first
    centres of the first codebook)."""
    parts, entries, _ = book.shape
    out = np.zeros((parts, entries), np.int64)
    for p in range(parts):
        centres = [0] if entries else []
        far = np.full(entries, np.inf)
        while len(centres) < min(groups, entries):
            far = np.minimum(far, ((book[p] - book[p, centres[-1]]) ** 2).sum(1))
            centres.append(int(far.argmax()))
        if centres:
            out[p] = ((book[p][:, None] - book[p, centres][None]) ** 2).sum(2).argmin(1)
    return out


def net_moves(history: list[np.ndarray], group_of: np.ndarray, groups: int) -> np.ndarray:
    """(rounds, parts, groups): the largest distance between an entry of the group now and in that round."""
    now = history[-1]
    out = np.zeros((len(history), now.shape[0], groups))
    for t, then in enumerate(history):
        moved = np.sqrt(((now - then).astype(np.float64) ** 2).sum(2)) * (1 + 1e-12)
        for p in range(now.shape[0]):
            np.maximum.at(out[t, p], group_of[p], moved[p])
    return out


def assigned(
    x: np.ndarray, history: list[np.ndarray], group_of: np.ndarray, groups: int, moves: np.ndarray,
    code: np.ndarray | None = None, bound: np.ndarray | None = None, stamp: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(code, squared distance, bound, stamp, scans) of one part position of vectors x (n, width).

    history and group_of are this position's codebooks and groups, moves (rounds, groups). bound
    (n, groups) is a lower bound of the distance to the entries of the group other than the assigned
    one, as of round stamp. Ties go to the lower entry. scans counts distances to entries taken anew.
    """
    book, now, n = history[-1], len(history) - 1, len(x)
    rows = np.arange(n)
    if code is None:
        own, code = np.full(n, _NONE), np.zeros(n, np.int64)
        low = np.zeros((n, groups))
        bound, stamp, need = low.copy(), np.full((n, groups), now, np.uint8), np.ones((n, groups), bool)
        before = np.full(n, -1)
    else:
        code, bound, stamp, before = code.astype(np.int64), bound.astype(np.float64), stamp.copy(), code.astype(np.int64)
        own = ((x - book[code]) ** 2).sum(1)
        low = bound - np.take_along_axis(np.broadcast_to(moves[None], (n, *moves.shape)), stamp[:, None, :].astype(np.int64), 1)[:, 0]
        need = ~(np.sqrt(own)[:, None] * (1 + 1e-12) < low)
    best, at, scans, seen = own.copy(), code.copy(), 0, []
    for g in range(groups):
        members, look = np.flatnonzero(group_of == g), np.flatnonzero(need[:, g])
        seen.append(None)
        if not len(members) or not len(look):
            continue
        d = ((x[look][:, None] - book[members][None]) ** 2).sum(2)
        scans += d.size
        order = d.argmin(1)
        first = d[np.arange(len(look)), order]
        rest = d.copy()
        rest[np.arange(len(look)), order] = _NONE
        seen[g] = look, members[order], first, rest.min(1)
        nearer = (first < best[look]) | ((first == best[look]) & (members[order] < at[look]))
        best[look[nearer]], at[look[nearer]] = first[nearer], members[order][nearer]
    for g, found in enumerate(seen):
        if found is not None:
            look, entry, first, second = found
            nearest = np.where(entry == at[look], second, first)
            bound[look, g] = np.where(nearest == _NONE, np.inf, np.sqrt(nearest.astype(np.float64)) * (1 - 1e-12))
            stamp[look, g] = now
    # an entry that is no longer the part's own enters the bound of its group, if that was not rescanned
    left = rows[(before >= 0) & (before != at)]
    if len(left):
        g = group_of[before[left]]
        kept = ~need[left, g]
        left, g = left[kept], g[kept]
        bound[left, g] = np.minimum(low[left, g], np.sqrt(own[left].astype(np.float64)) * (1 - 1e-12))
        stamp[left, g] = now
    return at, best, bound, stamp, scans


def _parted(batch: pa.RecordBatch, parts: int, width: int) -> np.ndarray:
    flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, parts, width)


def _bytes(column: pa.Array, n: int, shape: tuple[int, ...], kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(n, *shape)


def _binary(values: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in values], pa.binary())


def _round(state: DataFrame, history: list[np.ndarray], group_of: np.ndarray, groups: int, last: bool) -> DataFrame:
    """state (at, vec_id, label, x and, after the first round, code, bound, stamp) after an assignment."""
    parts, _, width = history[0].shape
    first = "code" not in state.columns
    spark = state.sparkSession
    shared = spark.sparkContext.broadcast((history, group_of, net_moves(history, group_of, groups)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, of_entry, moves = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                batch = whole.slice(at, STEP)
                n, x = batch.num_rows, _parted(batch, parts, width)
                if not first:
                    codes = _bytes(batch.column("code"), n, (parts,), np.uint8)
                    bounds = _bytes(batch.column("bound"), n, (parts, groups), np.float32)
                    stamps = _bytes(batch.column("stamp"), n, (parts, groups), np.uint8)
                code, error = np.zeros((n, parts), np.uint8), np.zeros(n, np.int64)
                bound, stamp = np.zeros((n, parts, groups), np.float32), np.zeros((n, parts, groups), np.uint8)
                scans = 0
                for p in range(parts):
                    old = () if first else (codes[:, p], bounds[:, p], stamps[:, p])
                    c, d, b, s, k = assigned(x[:, p], [h[p] for h in books], of_entry[p], groups, moves[:, p], *old)
                    # stored as single floats, rounded down
                    code[:, p], bound[:, p], stamp[:, p] = c, np.nextafter(b.astype(np.float32), np.float32(-1)), s
                    error, scans = error + d, scans + k
                given = {c: batch.column(c) for c in ("vec_id", "label", "x")}
                tail = {"error": pa.array(error)} if last else {"bound": _binary(bound), "stamp": _binary(stamp)}
                spent = pa.array(np.r_[scans, np.zeros(n - 1, np.int64)]) if n else pa.array([], pa.int64())
                if last:
                    given.pop("x")
                yield record(**given, code=_binary(code), scans=spent, **tail)
        give_back()

    kinds = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    label = f"label {kinds['label']}"
    if last:
        schema = f"vec_id long, {label}, code binary, scans long, error long"
    else:
        schema = f"vec_id long, {label}, x array<int>, code binary, scans long, bound binary, stamp binary"
    columns = ["vec_id", "label", "x"] + ([] if first else ["code", "bound", "stamp"])
    return state.select(columns).mapInArrow(run, schema)


def _moved(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebook whose entries are the floored means of their parts; unused ones stay."""
    parts, entries, width = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts * entries, width + 1), np.int64)
        for batch in batches:
            x = _parted(batch, parts, width)
            code = _bytes(batch.column("code"), batch.num_rows, (parts,), np.uint8).astype(np.int64)
            slot = (code + np.arange(parts) * entries).ravel()
            for j in range(width):
                # sums of whole numbers, exact below 2**53
                sums[:, j] += np.bincount(slot, x[:, :, j].ravel(), parts * entries).astype(np.int64)
            sums[:, width] += np.bincount(slot, minlength=parts * entries)
        used = np.flatnonzero(sums[:, width])
        yield record(slot=pa.array(used), **{f"s{j}": pa.array(sums[used, j]) for j in range(width + 1)})
        give_back()

    names = [f"s{j}" for j in range(width + 1)]
    partial = state.select("x", "code").mapInArrow(run, "slot long, " + ", ".join(f"{n} long" for n in names))
    total = partial.groupBy("slot").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = book.reshape(parts * entries, width).copy()
    if total.num_rows:
        slot, count = total["slot"].to_numpy(), total[names[-1]].to_numpy()
        for j in range(width):
            out[slot, j] = np.floor_divide(total[names[j]].to_numpy(), count)
    return out.reshape(book.shape)


def vector_codes(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16,
    entries: int = 64, rounds: int = 2, scale: int = 256, groups: int = 8,
) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error, scans), codebooks): the codes of all vectors, a byte a part, and
    the final integer codebooks (parts, entries, width).

    Rows whose vector is null or holds a null or non-finite component are left out; others become
    floor(scale * x). A part position's codebook starts as that part of the first ``entries`` rows
    by id, null ids last, rows of one id by vector (fewer rows: fewer entries). All vectors must have
    one length, a multiple of parts, and components within 2**24 after scaling; others are an error.
    Labels of any simple type, null too, pass through. entries is at most 256. Repeated rows are
    rows of their own. An empty table gives no rows and empty codebooks. scans sums to the number of
    distances taken (one figure for each batch, in its first row); groups only changes that number.
    """
    v = F.col(vector_col).cast("array<double>")
    finite = F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))
    scaled = F.transform(v, lambda c: F.floor(c * scale))
    fits = F.forall(scaled, lambda c: F.abs(c) <= LARGEST)
    whole = F.when(fits, scaled.cast("array<int>")).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling")))
    rows = written(vectors.where(finite).select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), whole.alias("x")))
    sizes = rows.agg(F.min(F.size("x")).alias("a"), F.max(F.size("x")).alias("b")).first()
    if sizes["a"] != sizes["b"] or (sizes["a"] or 0) % parts:
        raise ValueError(f"vectors of {sizes['a']} to {sizes['b']} components can't be cut into {parts} equal parts")
    width = (sizes["a"] or 0) // parts
    head = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").toArrow()
    start = np.array(head["x"].to_pylist(), np.int64).reshape(head.num_rows, parts, width)
    history = [np.ascontiguousarray(start.transpose(1, 0, 2))]
    if not len(start):
        return rows.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("scans")), history[0]
    group_of, state = entry_groups(history[0], groups), rows
    for _ in range(rounds):
        state = written(_round(state, history, group_of, groups, False))
        history.append(_moved(state, history[-1]))
    return materialised(_round(state, history, group_of, groups, True)), history[-1]


def label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error: error summed over equal labels, nulls together."""
    totals = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    return codes.join(totals, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
