"""Exact top-k search with block-at-a-time pruning.

Rows are put in an order that keeps similar vectors together, and consecutive ones make blocks: a
forward index (ids and integer terms) with the largest and the smallest value of every term in the
block. A query's bound on a block is the sum over its terms of weight times the extreme that favours
it. Each query visits the blocks by falling bound and stops where the bound falls below its k-th
best score; equal bounds are still visited, as ties go to the smaller id.

The order is that of the nearest and second nearest of a few pivot rows; runs of it are cells, cut
by count, so that a pivot with most of the rows has many cells. Within a cell, halving at the
median of the widest term gives the blocks. The order is only a matter of cost, never of results.

Every query first visits one cell alone, its home among rows with the same pivots. The k-th score
there is a floor: what lies below it is not among the k best of all. Cells have extremes as blocks
have, and only the queries whose bound on a cell reaches their floor go there; a cell is sent to
those groups of queries alone that have one. Tasks are of bounded size and neither side is gathered
by the driver, which holds the pivots and the row counts by pair of pivots, at most pivots**2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialised, record


def quantised(column: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part, and floor(scale * x) of their components.

    Rows that are null or hold a null, NaN or infinite component take no part. Shorter vectors
    are filled up with zeros to the longest of the batch.
    """
    flat = column.flatten()
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    x = np.floor(scale * np.asarray(flat.cast(pa.float64()).fill_null(np.nan), np.float64))
    row = np.repeat(np.arange(len(sizes)), sizes)
    bad = np.zeros(len(sizes), bool)
    bad[row[~np.isfinite(x)]] = True
    bad |= np.asarray(column.is_null())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[row, np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.where(np.isfinite(x), x, 0)
    good = np.flatnonzero(~bad)
    return good, out[good]


def _packed(x: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Rows of integers as little-endian bytes, and the bytes a component takes: 2 or 8 (a double)."""
    small = x.size == 0 or (np.abs(x).max() < 2**15)
    rows = x.astype("<i2" if small else "<f8")
    return pa.array([r.tobytes() for r in rows], pa.binary()), pa.array([2 if small else 8] * len(rows), pa.int32())


def _unpacked(terms: list[bytes], sizes: list[int], rows: list[int] | None = None) -> list[np.ndarray]:
    """The matrices of doubles that such bytes hold, one row each where rows is None."""
    counts = [1] * len(terms) if rows is None else rows
    kinds = {2: "<i2", 8: "<f8"}
    return [np.frombuffer(t, kinds[s]).reshape(n, -1).astype(float) for t, s, n in zip(terms, sizes, counts, strict=True)]


def _placed(scale: float, pivots: np.ndarray):
    """Rows as integer terms with the number of their nearest and second nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms, row = (pivots * pivots).sum(1), 0
        for batch in batches:
            good, x = quantised(batch.column("vector"), scale)
            if not len(good):
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)[good]
            width = min(x.shape[1], pivots.shape[1])
            far = norms - 2 * x[:, :width] @ pivots[:, :width].T
            near = np.argsort(far, axis=1, kind="stable")[:, :2] if far.size else np.zeros((len(ids), 1), int)
            terms, size = _packed(x)
            yield record(
                id=pa.array(ids, pa.int64()), terms=terms, size=size,
                place=pa.array(near[:, 0] * max(1, len(pivots)) + near[:, -1], pa.int64()),
                row=pa.array((TaskContext.get().partitionId() << 40) + row + np.arange(len(ids)), pa.int64()),
            )
            row += len(ids)

    return run


PLACED = "id long, terms binary, size int, place long, row long"


def halved(x: np.ndarray, least: int) -> list[np.ndarray]:
    """Row numbers of x in runs of at most ``least``: halves at the median of the widest term, again and again."""
    waiting, done = [np.arange(len(x))], []
    while waiting:
        rows = waiting.pop()
        if len(rows) <= least:
            done.append(rows)
            continue
        widest = np.argmax(x[rows].var(0)) if x.shape[1] else 0
        order = np.argsort(x[rows, widest], kind="stable") if x.shape[1] else np.arange(len(rows))
        middle = -(-len(rows) // (2 * least)) * least
        waiting += [rows[order[middle:]], rows[order[:middle]]]
    return done


def _index_cell(block_rows: int):
    """The blocks of a cell, and a row with block -1 for the cell's own extremes (highest, lowest)."""

    def run(cell: pa.Table) -> pa.Table:
        rows = _unpacked(cell["terms"].to_pylist(), cell["size"].to_pylist())
        width = max(r.shape[1] for r in rows)
        x = np.concatenate([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in rows])
        ids, number = cell["id"].to_numpy(), cell["cell"][0].as_py()
        runs = [r[np.argsort(ids[r], kind="stable")] for r in halved(x, block_rows)]
        parts = [x[r] for r in runs] + [np.stack([x.max(0), x.min(0)])]
        packed = [_packed(p.reshape(1, -1)) for p in parts]
        return pa.table({
            "cell": pa.array([number] * len(parts), pa.int32()),
            "block": pa.array([*range(len(runs)), -1], pa.int32()),
            "rows": pa.array([len(p) for p in parts], pa.int32()),
            "ids": pa.array([*(ids[r].astype("<i8").tobytes() for r in runs), b""], pa.binary()),
            "terms": pa.concat_arrays([t for t, _ in packed]),
            "size": pa.concat_arrays([n for _, n in packed]),
        })

    return run


def _reached(extremes: pa.Table, queries: pa.Table) -> pa.Table:
    """(query, cell, home), once each, of the cells, but a query's home, whose bound reaches the query's floor."""
    names = ["query", "cell", "home"]
    if not extremes.num_rows or not queries.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int32())], names=names)
    ends = _unpacked(extremes["terms"].to_pylist(), extremes["size"].to_pylist(), extremes["rows"].to_pylist())
    rows = _unpacked(queries["terms"].to_pylist(), queries["size"].to_pylist())
    width = max(m.shape[1] for m in [*ends, *rows])
    ends = _padded(ends, width)
    weights = np.concatenate([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in rows])
    bounds = np.maximum(weights, 0) @ ends[:, 0].T + np.minimum(weights, 0) @ ends[:, 1].T
    floor = queries["floor"].fill_null(-np.inf).to_numpy()
    cells, home = extremes["cell"].to_numpy(), queries["home"].to_numpy()
    q, c = np.nonzero((bounds >= floor[:, None]) & (cells[None, :] != home[:, None]))
    found = [pa.array(queries["query"].to_numpy()[q]), pa.array(cells[c], pa.int32()), pa.array(home[q], pa.int32())]
    return pa.table(found, names=names).group_by(names).aggregate([]).select(names)


def _padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    return np.stack([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in rows]) if rows else np.empty((0, 0, width))


def block_search(
    queries: np.ndarray, weights: np.ndarray, ids: list[np.ndarray], terms: list[np.ndarray], k: int, floor: np.ndarray
) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (ids, scores) of every query, best first, -inf where there are fewer; and how many
    query-block pairs were scored. Every block's ids ascend. Scores below a query's floor are left
    out, -inf as well."""
    n = len(queries)
    high = np.stack([t.max(0) for t in terms])
    low = np.stack([t.min(0) for t in terms])
    bounds = np.maximum(weights, 0) @ high.T + np.minimum(weights, 0) @ low.T
    order = np.argsort(-bounds, axis=1, kind="stable")
    best = np.full((n, k), -np.inf)
    who = np.full((n, k), np.iinfo(np.int64).max)
    live, scored = np.arange(n), 0
    for turn in range(len(terms)):
        block = order[live, turn]
        open_ = bounds[live, block] >= np.maximum(best[live, -1], floor[live])
        live, block = live[open_], block[open_]
        if not len(live):
            break
        scored += len(live)
        for b in np.unique(block):
            q = live[block == b]
            scores = weights[q] @ terms[b].T
            scores[queries[q, None] == ids[b][None, :]] = -np.inf
            scores[scores < floor[q, None]] = -np.inf
            some = scores.max(1) >= np.maximum(best[q, -1], floor[q])
            q, scores = q[some], scores[some]
            if not len(q):
                continue
            all_s = np.concatenate([best[q], scores], 1)
            all_i = np.concatenate([who[q], np.broadcast_to(ids[b], scores.shape)], 1)
            top = np.lexsort((all_i, -all_s), axis=-1)[:, :k]
            best[q] = np.take_along_axis(all_s, top, 1)
            who[q] = np.take_along_axis(all_i, top, 1)
    return who, best, scored


def _search(k: int, count: Accumulator | None):
    def run(blocks: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not blocks.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64())] * 3, names=names)
        blocks = blocks.sort_by("block")
        ids = [np.frombuffer(b, "<i8") for b in blocks["ids"].to_pylist()]
        terms = _unpacked(blocks["terms"].to_pylist(), blocks["size"].to_pylist(), [len(i) for i in ids])
        qid = queries["query"].to_numpy()
        rows = _unpacked(queries["terms"].to_pylist(), queries["size"].to_pylist())
        width = max(t.shape[1] for t in [*terms, *rows])
        terms = [np.pad(t, ((0, 0), (0, width - t.shape[1]))) for t in terms]
        weights = np.concatenate([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for r in rows])
        floor = queries["floor"].fill_null(-np.inf).to_numpy()
        who, best, scored = block_search(qid, weights, ids, terms, k, floor)
        if count is not None:
            count.add(scored)
        found = np.isfinite(best)
        return pa.table(
            [pa.array(np.repeat(qid, found.sum(1))), pa.array(who[found]), pa.array(best[found].astype(np.int64))], names=names
        )

    return run


def _pivots(rows: DataFrame, scale: float, pivots: int) -> np.ndarray:
    """Integer terms of the rows whose ids hash smallest, ``pivots`` at most; to the driver, as they are few."""
    few = rows.orderBy(F.xxhash64("id"), "id").limit(pivots).select("vector").toArrow()["vector"].combine_chunks()
    return quantised(few, scale)[1] if len(few) else np.zeros((0, 0))


def top_k_search(
    vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5,
    scale: float = 256.0, block_rows: int = 128, cell_rows: int = 8192, group_rows: int = 8192, pivots: int = 64,
    count: Accumulator | None = None,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row its k best other rows, exactly.

    The score is the inner product of the components floor(scale * x); every product must be
    below 2**53. Ties go to the smaller id. Rows with a null id, a null vector or a null or
    non-finite component take no part; shorter vectors count as filled with zeros. Rows that
    share a query's id are never its results, and equal query rows are one query. Ids are integers.
    ``count``, if given, gathers how many query-block pairs were scored.
    """
    given = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    asked = queries.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    place = _placed(scale, _pivots(given, scale, pivots))
    rows = materialised(given.mapInArrow(place, PLACED))
    sizes = rows.groupBy("place").agg(F.count("*").alias("n")).orderBy("place").toArrow()
    n = sizes["n"].to_numpy()
    cells = max(1, -(-int(n.sum()) // cell_rows))
    runs = list(zip(sizes["place"].to_pylist(), n.tolist(), (np.cumsum(n) - n).tolist(), strict=True))
    runs = F.broadcast(given.sparkSession.createDataFrame(runs, "place long, n long, before long"))

    def in_cell(df: DataFrame, *key: str) -> DataFrame:
        """df with its cell: the count before its place, and a share of the place by a hash of the key."""
        at = F.col("before") + F.pmod(F.xxhash64(*key), F.col("n"))
        return df.join(runs, "place", "left").withColumn("cell", F.coalesce(F.floor(at / cell_rows), F.lit(-1)).cast("int"))

    index = in_cell(rows, "id", "row").select("id", "terms", "size", "cell").groupBy("cell")
    index = materialised(index.applyInArrow(_index_cell(block_rows), "cell int, block int, rows int, ids binary, terms binary, size int"))
    asked = asked.mapInArrow(place, PLACED).select(F.col("id").alias("query"), "terms", "size", "place").distinct()
    asked = materialised(in_cell(asked, "query").select("query", "terms", "size", F.col("cell").alias("home")))
    groups = max(1, -(-asked.count() // group_rows))
    blocks = index.where("block >= 0").select("cell", "block", "ids", "terms", "size")

    def group(count: int) -> Column:
        return F.pmod(F.xxhash64("query"), F.lit(count)).cast("int").alias("grp")

    def searched(asked: DataFrame, places: DataFrame) -> DataFrame:
        """Scores of the queries (query, terms, size, floor, cell, grp) in their cells; blocks go to the groups of places."""
        wanted = places.select("cell", group(groups).alias("to")).distinct()
        return (
            blocks.join(wanted, "cell").groupBy("cell", "to").cogroup(asked.groupBy("cell", "grp"))
            .applyInArrow(_search(k, count), "query_id long, vec_id long, score long")
        )

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    no_floor = F.lit(None).cast("double").alias("floor")
    # a home may be that of a third of the queries, so that groups are of all queries here too
    at_home = asked.select("query", "terms", "size", no_floor, F.col("home").alias("cell"), group(groups))
    found = searched(at_home, asked.select("query", F.col("home").alias("cell")))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    if cells > 1:
        found = materialised(found)
        floors = found.where(F.col("rank") == k).select(F.col("query_id").alias("query"), F.col("score").cast("double").alias("floor"))
        asked = asked.join(floors.dropDuplicates(["query"]), "query", "left")
        # a thousand cells' extremes meet a group of queries in a task
        chunks = -(-cells // 1024)
        chunk = F.floor(F.col("cell") / 1024).cast("int").alias("chunk")
        ends = index.where("block < 0").select("cell", "rows", "terms", "size", chunk, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"))
        at_ends = asked.select("*", group(groups), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
        near = ends.groupBy("chunk", "grp").cogroup(at_ends.groupBy("chunk", "grp")).applyInArrow(_reached, "query long, cell int, home int")
        near = materialised(near)
        abroad = asked.join(near, ["query", "home"]).select("query", "terms", "size", "floor", "cell", group(groups))
        found = found.drop("rank").unionByName(searched(abroad, near))
        found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")
