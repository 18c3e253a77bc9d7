"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

G = ("repository_id", "revision")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a temporary one where none is set, for local sessions only."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows behind a reliable checkpoint."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def top(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group and their ranks."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def ranked(df: DataFrame, by: list[str], order: list[Column], rank: str = "rank", size: str | None = None) -> DataFrame:
    """``df`` with each row's number within its group, from 1, and the group's ``size`` if named; in two passes, whatever a group's size.

    Rows are dealt in ranges of (``by``, ``order``) and keep their places in a range; a table with a row for each range and group in it
    says how many rows of the group lie in earlier ranges. ``order`` must fix the order of rows that differ; nulls are a group.
    """
    keys = [*(F.col(c).asc_nulls_first() for c in by), *order]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # the row number of Spark's id is its lower 33 bits
    laid = cut(df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    counts = laid.groupBy(*by, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    above = F.coalesce(F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*by, "_range", (above + 1 - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("_size")).alias("c")
    if not by:
        counts = F.broadcast(counts)  # a row for each range
    same = [F.col("d._range") == F.col("c._range"), *(F.col(f"d.`{c}`").eqNullSafe(F.col(f"c.`{c}`")) for c in by)]
    new = [(F.col("_at") + F.col("_shift")).alias(rank), *([F.col("_size").alias(size)] if size else [])]
    return laid.alias("d").join(counts, same).select(*(F.col(f"d.`{c}`") for c in df.columns if c not in (rank, size)), *new)


def ancestors(path: Column) -> Column:
    """All directories above a path, the empty one first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def owner_by_prefix(paths: DataFrame, owners: DataFrame, by: list[str], *, path: str = "path", directory: str = "directory") -> DataFrame:
    """``paths`` with the owner (other columns of ``owners``) of the longest directory above the path; equi-join on each ancestor."""
    levels = paths.select(*by, path).distinct().withColumn(directory, F.explode(ancestors(F.col(path))))
    rest = [c for c in owners.columns if c not in (*by, directory)]
    best = levels.join(owners, [*by, directory]).groupBy(*by, path).agg(F.max_by(F.struct(*rest), F.struct(F.length(directory), *rest)).alias("_owner"))
    return paths.join(best, [*by, path], "left").select(*paths.columns, *(F.col("_owner")[c].alias(c) for c in rest))


#: Bits of the narrowest bins of spans.
NARROW = 6


def interval_join(left: DataFrame, right: DataFrame, by: list[str], *, tolerance: int = 0, how: str = "inner") -> DataFrame:
    """Rows of equal keys whose closed spans overlap within ``tolerance``: left (l_start, l_end) and right (r_start, r_end).

    A span's level is the power of two that its length stays below, so it lies in one or two bins of its level, or of a higher one. It
    stands in bins of its own level and of those higher levels that the other side has, and a pair meets at the higher level of the two,
    in the bin where its overlap begins, once. So a span costs a few rows whatever its length, and a hot path with many lines spreads
    over many tasks. Spans without a start never match; one without an end is a line. how: inner, left_semi or left.
    """
    numbered = cut(left.withColumn("_row", F.monotonically_increasing_id())) if how != "inner" else left

    def level(low: str, high: str) -> Column:
        return F.greatest(F.lit(NARROW), F.length(F.bin(F.greatest(F.col(high) - F.col(low), F.lit(0)))))

    probe = numbered.where("l_start is not null").withColumns({"_low": (F.col("l_start") - tolerance).cast("long"), "_high": (F.coalesce("l_end", "l_start") + tolerance).cast("long")}).withColumn("_l", level("_low", "_high"))
    build = right.where("r_start is not null").withColumns({"_first": F.col("r_start").cast("long"), "_end": F.coalesce("r_end", "r_start").cast("long")}).withColumn("_r", level("_first", "_end"))

    def binned(side: DataFrame, other: DataFrame, own: str, its: str, low: str, high: str) -> DataFrame:
        levels = other.agg(F.collect_set(its).alias("_levels"))  # one row, of 64 numbers at most
        mine = F.concat(F.when(F.exists("_levels", lambda x: x <= F.col(own)), F.array(own)).otherwise(F.array().cast("array<int>")), F.filter("_levels", lambda x: x > F.col(own)))
        side = side.join(F.broadcast(levels)).withColumn("_level", F.explode(mine)).drop("_levels")
        bins = F.expr(f"sequence(shiftright({low}, _level), shiftright(greatest({low}, {high}), _level))")
        return side.withColumn("_bin", F.explode(bins))

    pairs = binned(probe, build, "_l", "_r", "_low", "_high").join(binned(build, probe, "_r", "_l", "_first", "_end"), [*by, "_level", "_bin"])
    pairs = pairs.where((F.col("_low") <= F.col("_end")) & (F.col("_first") <= F.col("_high")) & (F.greatest("_l", "_r") == F.col("_level")))
    pairs = pairs.where(F.expr("shiftright(greatest(_low, _first), _level) = _bin")).drop("_bin", "_level", "_l", "_r", "_low", "_high", "_first", "_end")
    if how == "inner":
        return pairs
    if how == "left_semi":
        return numbered.join(pairs.select("_row").distinct(), "_row", "left_semi").drop("_row")
    new = [c for c in right.columns if c not in by]
    return numbered.join(pairs.select("_row", *new), "_row", "left").drop("_row")


def dominant_pairs(edges: DataFrame, by: list[str], rounds: int = 6) -> DataFrame:
    """The ``edges`` (``by``, old, new, weight and others; distinct in the first three) that a greedy choice takes, heaviest first, ties by
    old and new, each end once.

    In a round, every edge that comes first at both its ends is taken, and both ends go: no edge before it in the greedy order could
    have taken either. What a few rounds leave are long chains of ties, in which a round takes little; their edges are dealt out by
    ``by``, sorted, and folded as they stream by, with no more in memory than the ends taken in the present group.
    """
    left, done = cut(edges), []
    names = left.columns
    at = [names.index(c) for c in (*by, "old", "new")]
    for _ in range(rounds):
        if not left.take(1):
            break
        first = [left.groupBy(*by, x).agg(F.min(F.struct(-F.col("weight"), F.col(y).alias("other")))["other"].alias(f"best_{x}")) for x, y in (("old", "new"), ("new", "old"))]
        taken = left.join(first[0], [*by, "old"]).where("best_old = new").join(first[1], [*by, "new"]).where("best_new = old")
        done.append(taken := cut(taken.select(*names)))
        left = cut(left.join(taken.select(*by, "old"), [*by, "old"], "left_anti").join(taken.select(*by, "new"), [*by, "new"], "left_anti").select(*names))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used = None, (set(), set())
        for b in batches:
            keep, rows = [], zip(*(b.column(i).to_pylist() for i in at))
            for i, (*key, old, new) in enumerate(rows):
                if key != group:
                    group, used = key, (set(), set())
                if old not in used[0] and new not in used[1]:
                    used[0].add(old)
                    used[1].add(new)
                    keep.append(i)
            yield b.take(pa.array(keep, pa.int64()))

    done.append(left.repartition(*by).sortWithinPartitions(*by, F.desc("weight"), "old", "new").mapInArrow(fold, left.schema))
    return reduce(DataFrame.unionByName, done)


def components(edges: DataFrame, nodes: DataFrame, by: list[str], rounds: int = 200) -> DataFrame:
    """(by, node, component): connected components of undirected edges (source, target), named by their smallest node."""
    both = cut(edges.select(*by, "source", "target").union(edges.select(*by, F.col("target"), F.col("source"))).distinct())
    now = cut(nodes.select(*by, "node", F.col("node").alias("component")).distinct())
    for _ in range(rounds):
        near = now.join(both, [*(now[c] == both[c] for c in by), now["node"] == both["source"]]).select(*(now[c] for c in by), both["target"].alias("node"), "component")
        new = now.union(near).groupBy(*by, "node").agg(F.min("component").alias("component"))
        # pointer jump: the component of the node that names mine
        names = new.select(*by, F.col("node").alias("component"), F.col("component").alias("far"))
        new = cut(new.join(names, [*by, "component"], "left").select(*by, "node", F.coalesce("far", "component").alias("component")))
        if not new.join(now, [*by, "node", "component"], "left_anti").take(1):
            return new
        now = new
    raise RuntimeError("components did not settle")
