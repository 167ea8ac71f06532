"""A Merkle manifest of a dataset: a content-addressed DAG, and proofs by descent from its root.

Rows are ranked within their group without a global sort; runs of consecutive nodes are hashed level
by level, and every run becomes a record from its digest to its children. Proofs are read off these
records: a request for a leaf descends from the root by the digits of its rank, takes from each
record the children that it does not follow, and its segments are reversed on the way, so that the
leaf's own come first. Requests that share a node share the descent to it: a level costs its nodes,
not its leaves, and a leaf meets its path only in its last run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialised, written

FANOUT = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEGMENT = "array<struct<before:string,after:string>>"


def digest(column: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(column.cast("binary"), 256)


def framed(column: Column) -> Column:
    """A value as it enters a hash: - for null, else the count of its bytes, a colon, and itself."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    return digest(F.concat(*[framed(c) for c in columns]))


def lowered(text: Column) -> Column:
    """A to Z as a to z, everything else unchanged."""
    return F.translate(text, UPPER, LOWER)


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with ``rank`` (long, from 0) within the non-null group by the order columns, nulls first,
    and the group's size ``n``.

    Rows are dealt by ranges of (group, order) and numbered within a range; what a group has in
    earlier ranges is a running sum over its ranges. Rows that are equal in all of these part by
    where they were read, so neither a large group nor a repeated row is one task's work.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [group, *order, "__at"]
    dealt = rows.withColumn("__at", F.monotonically_increasing_id()).repartitionByRange(tasks, *keys)
    # numbers ascend within a partition, whose own number is their high part
    dealt = written(dealt.sortWithinPartitions(*keys).withColumn("__seq", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("__range", F.shiftright("__seq", 33))
    counts = dealt.groupBy(group, "__range").agg(F.count("*").alias("__rows"), F.min("__seq").alias("__first"))
    by_group = Window.partitionBy(group)
    before = F.sum("__rows").over(by_group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(
        group, "__range", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__rows").over(by_group).alias("n")
    )
    kept = [F.col(c) for c in rows.columns if c not in ("rank", "n")]
    met = dealt.drop("n", "rank").join(materialised(starts), [group, "__range"])
    return met.select(*kept, (F.col("__seq") + F.col("__shift")).alias("rank"), "n")


@dataclass
class Trees:
    """The trees over groups of nodes: of each level, lowest first, the records (grp, rank, n, digest,
    children), and the tops (grp, digest, height)."""

    levels: list[DataFrame]
    tops: DataFrame
    fanout: int


def grown(nodes: DataFrame, fanout: int = FANOUT) -> Trees:
    """The trees over nodes (grp, rank, n, digest); a group's lone node is its top at height 0."""
    levels: list[DataFrame] = []
    lone = lambda df, height: df.where("n = 1").select("grp", "digest", F.lit(height).alias("height"))
    tops, most = lone(nodes, 0), nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        runs = nodes.where("n > 1").groupBy("grp", F.expr(f"rank div {fanout}").alias("rank"), "n")
        made = runs.agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda c: c["digest"]).alias("children"))
        up = F.ceil(F.col("n") / fanout).cast("long")
        level = written(made.select("grp", "rank", up.alias("n"), digest(F.array_join("children", "")).alias("digest"), "children"))
        levels.append(level)
        nodes, most = level.select("grp", "rank", "n", "digest"), -(-most // fanout)
        tops = tops.unionByName(lone(nodes, len(levels)))
    return Trees(levels, tops, fanout)


def segment(children: Column, digit: Column) -> Column:
    """The children without the one at ``digit``, as what stands before it and behind it."""
    return F.struct(
        F.array_join(F.slice(children, 1, digit), "").alias("before"),
        F.array_join(F.slice(children, digit + 2, F.size(children)), "").alias("after"),
    )


def open_runs(trees: Trees, front: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """The lowest runs (grp, run, children, path, lone, and front's other columns) of the trees under
    the tops of front (grp, digest, height, path, ...); path are the segments from there to the root.

    An open node finds its record by its digest; each child is a digit of the ranks below. Records
    of equal digests are equal, so one stands for all. With requests (grp, rank), only nodes above
    them are opened. A tree of one leaf is a run whose leaf is its top (lone).
    """
    fanout, more = trees.fanout, [c for c in front.columns if c not in ("grp", "digest", "height", "path")]
    ended = front.where("height = 0").select(
        "grp", F.lit(0).cast("long").alias("run"), F.array("digest").alias("children"), "path", F.lit(True).alias("lone"), *more
    )
    nodes = None
    for height in range(len(trees.levels), 0, -1):
        begun = front.where(F.col("height") == height).select("grp", F.lit(0).cast("long").alias("run"), "digest", "path", *more)
        nodes = begun if nodes is None else nodes.unionByName(begun)
        if requests is not None:
            wanted = requests.select("grp", F.expr(f"rank div {fanout**height}").alias("run")).distinct()
            nodes = nodes.join(wanted, ["grp", "run"], "left_semi")
        stored = trees.levels[height - 1].groupBy("digest").agg(F.first("children").alias("children"))
        found = nodes.join(stored, "digest").select("grp", "run", "children", "path", *more)
        if height == 1:
            return ended.unionByName(found.withColumn("lone", F.lit(False)))
        steps = found.select("*", F.posexplode("children").alias("digit", "digest"))
        nodes = steps.select(
            "grp", (F.col("run") * fanout + F.col("digit")).alias("run"), "digest",
            F.concat(F.array(segment(F.col("children"), F.col("digit"))), "path").alias("path"), *more,
        )
    return ended


def with_paths(leaves: DataFrame, runs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """leaves (grp, rank, ...) with the path of each, its own segment first, and the runs' other columns."""
    keyed = leaves.withColumn("run", F.expr(f"rank div {fanout}"))
    own = F.array(segment(F.col("children"), F.pmod(F.col("rank"), F.lit(fanout)).cast("int")))
    met = keyed.join(runs, ["grp", "run"])
    whole = F.when(F.col("lone"), F.col("path")).otherwise(F.concat(own, "path"))
    return met.withColumn("path", whole).drop("run", "children", "lone")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda below, s: digest(F.concat(s["before"], below, s["after"])))


def siblings(path: Column) -> Column:
    """The digests of a path, from the leaf's run to the root's, each level from left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


@dataclass
class Manifest:
    """leaves (id, source, grp, rank, n, digest, second); the trees of the sources and the one over their
    tops; subroots (grp, source, digest, height, rank, n); root (None without a row)."""

    leaves: DataFrame
    trees: Trees
    over: Trees
    subroots: DataFrame
    root: str | None


def merkle_manifest(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars",
    text_col: str = "text", tamper: tuple[Column, Column] | None = None, fanout: int = FANOUT,
) -> Manifest:
    """The manifest of docs: a tree for each source, and one over the sources' tops.

    Ids and sizes are integers, null like any other value allowed. Leaves ascend by id, nulls
    first, rows of one id by digest; equal rows are leaves of their own. Sources ascend by UTF-8
    bytes, null first; an empty source is one of its own. tamper, if given, is (which rows, their
    text instead): their leaf is then also computed with that text, as ``second``. An empty table
    has no root. Columns beyond these are not read.
    """
    key, source = F.col(id_col).cast("long"), F.col(source_col).cast("string")
    leaf = lambda text: leaf_digest(key, source, F.col(lang_col), F.col(size_col).cast("long"), text)
    which, instead = tamper or (F.lit(False), F.col(text_col))
    second = F.when(which, leaf(instead))
    # written first: dealing by ranges looks at the rows twice, and texts are hashed once
    rows = written(docs.select(key.alias("id"), source.alias("source"), framed(source).alias("grp"), leaf(F.col(text_col)).alias("digest"), second.alias("second")))
    leaves = written(ranked(rows, "grp", ["id", "digest"]))
    trees = grown(leaves, fanout)
    names = leaves.where("rank = 0").select("grp", "source")
    tops = trees.tops.join(names, "grp").withColumnRenamed("grp", "part").withColumn("grp", F.lit(""))
    tops = materialised(ranked(tops, "grp", ["source"]))
    over = grown(tops.select("grp", "rank", "n", "digest"), fanout)
    top = over.tops.first()
    return Manifest(leaves, trees, over, tops, top["digest"] if top else None)


def merkle_proofs(manifest: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """(id, source, rank, digest, second, subroot, path): the proof of every leaf, or of those with a rank
    and source (null a source of its own) in requests.

    path goes from the leaf's run by its source's top to the root: segments of the other children
    of each run, before and after the one proved. Requests without a leaf give no row; repeated ones
    give one.
    """
    fanout, leaves, wanted = manifest.trees.fanout, manifest.leaves, None
    none = F.array().cast(SEGMENT)
    base = manifest.over.tops.select("grp", "digest", "height", none.alias("path"))
    tops = with_paths(manifest.subroots, open_runs(manifest.over, base), fanout)
    if requests is not None:
        wanted = requests.select(framed(F.col("source")).alias("grp"), F.col("rank").cast("long").alias("rank")).distinct()
        leaves, tops = leaves.join(wanted, ["grp", "rank"], "left_semi"), tops.join(wanted.select(F.col("grp").alias("part")).distinct(), "part", "left_semi")
    front = tops.select(F.col("part").alias("grp"), "digest", "height", "path", F.col("digest").alias("subroot"))
    found = with_paths(leaves, open_runs(manifest.trees, front, wanted), fanout)
    return found.select("id", "source", "rank", "digest", "second", "subroot", "path")
