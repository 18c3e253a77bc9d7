"""A Merkle manifest of a dataset, kept as a content-addressed graph of digests.

Each row is a leaf; the leaves of a source form a tree of runs of three, and the sources' roots another one above them. Building it stores
one record for each inner node, (digest, children), under the node's own digest and nothing else, so equal parts are stored once. A proof
is found by descent: a request goes down from the root by the digits of its leaf's number to the base of three, takes at each record
the child of its digit, collects the children it does not take, and at the leaf reverses the segments of its path. Requests with a
common beginning descend it together, so a level of the descent has as many rows as the level has requested nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evigraph.operators.common import ranked

from .common import cut, new_path, union

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN = 3
#: Levels that one task builds above a group of FAN ** LEVELS nodes.
LEVELS = 6
RECORD = "tree string, place bigint, n bigint, height int, digest binary, children array<binary>"
PATH = "array<struct<digit:int,others:array<binary>>>"


def leaf_of(values: list[Column]) -> Column:
    """The digest of a row's values: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def height_of(n: Column) -> Column:
    """Levels above ``n`` nodes."""
    return sum(((n > FAN**k).cast("int") for k in range(39)), F.lit(0))


@dataclass
class Manifest:
    """leaves: the rows' own columns, tree, place (from 0), leaf; records: height, digest, children; subroots: source, tree, place, n, digest;
    root: a row with the digest, none for an empty table."""

    leaves: DataFrame
    records: DataFrame
    top_records: DataFrame
    subroots: DataFrame
    root: DataFrame


def _build(batches: Iterator[pa.RecordBatch], done: int, levels: int) -> Iterator[pa.RecordBatch]:
    """Records of up to ``levels`` levels above groups of nodes of the level ``done``: (tree, place of the group, n, digests)."""
    schema = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("height", pa.int32()), ("digest", pa.binary()), ("children", pa.list_(pa.binary()))])
    for b in batches:
        out: list[dict] = []
        for g in b.to_pylist():
            now, left, place = g["digests"], -(-g["n"] // FAN**done), g["place"] * FAN**levels
            for height in range(done + 1, done + levels + 1):
                if left <= 1:
                    break
                left, place = -(-left // FAN), place // FAN
                runs = [now[i : i + FAN] for i in range(0, len(now), FAN)]
                now = [hashlib.sha256("".join(d.hex() for d in r).encode()).digest() for r in runs]
                out += [{"tree": g["tree"], "place": place + i, "n": g["n"], "height": height, "digest": d, "children": r} for i, (d, r) in enumerate(zip(now, runs))]
        yield pa.RecordBatch.from_pylist(out, schema)


def trees(nodes: DataFrame, sizes: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(records, tops) of the trees over ``nodes`` (tree, place, digest), where ``sizes`` has n and the height for each tree.

    A record is (height, digest, children); a top is (tree, n, height, digest). A tree of one node has that node as its top.
    """
    spark = nodes.sparkSession
    highest, lone = sizes.agg(F.max("height")).first()[0] or 0, sizes.where("height = 0")
    tops = [nodes.join(lone, "tree").select("tree", "n", "height", "digest")]
    path, now, found = new_path(spark, "records"), nodes, spark.createDataFrame([], RECORD)
    for done in range(0, highest, levels):
        part = F.floor(F.col("place") / FAN**levels).alias("group")
        groups = now.groupBy("tree", part).agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("rows")).join(sizes.where(F.col("height") > done), "tree")
        groups = groups.select("tree", F.col("group").alias("place"), "n", F.col("rows.digest").alias("digests"))
        # one folder for each round, so that a later round does not list what it does not read
        groups.mapInArrow(lambda batches, done=done: _build(batches, done, levels), RECORD).write.parquet(f"{path}/done={done}")
        found = spark.read.schema(f"{RECORD}, done int").parquet(path).drop("done")
        now = found.where(F.col("height") == done + levels).select("tree", "place", "digest")
    tops.append(found.where("place = 0").join(sizes, ["tree", "height"]).select("tree", found["n"], "height", "digest"))
    return found.select("height", "digest", "children"), union(tops)


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, also: dict[str, Column] | None = None, levels: int = LEVELS) -> Manifest:
    """The manifest of ``docs``: leaves of ``fields`` ascend by doc_id (nulls first, equal ids by digest) within each source.

    ``also`` adds columns to the leaves; a task builds ``levels`` levels at once. A null source is a source of its own and comes first; null values differ from empty ones; equal
    rows are leaves of their own; other columns are not read. Only digests are shuffled, and numbers are given in ranges of rows.
    """
    # a null source, and then the others by their bytes
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = docs.select("doc_id", "source", tree.alias("tree"), F.unhex(leaf_of([F.col(c) for c in fields])).alias("digest"), *(c.alias(k) for k, c in (also or {}).items()))
    leaves = cut(ranked(rows, ["tree"], [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()], "place").withColumn("place", F.col("place") - 1))
    sizes = cut(leaves.groupBy("tree").agg(F.count("*").alias("n"), F.first("source").alias("source")).withColumn("height", height_of(F.col("n"))))
    records, tops = trees(leaves.select("tree", "place", "digest"), sizes.select("tree", "n", "height"), levels)
    subroots = cut(ranked(tops, [], [F.col("tree").asc()], "place").withColumn("place", F.col("place") - 1))
    all_of_them = cut(subroots.agg(F.lit("").alias("tree"), F.count("*").alias("n")).where("n > 0").withColumn("height", height_of(F.col("n"))))
    top_records, root = trees(subroots.select(F.lit("").alias("tree"), "place", "digest"), all_of_them, levels)
    return Manifest(leaves, records, top_records, subroots.join(sizes.select("tree", "source"), "tree"), cut(root))


def descend(records: DataFrame, starts: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """(tree, place, digest, path) of requested leaves, from ``starts`` (tree, height, digest, path) down; ``path`` gets a segment a level.

    ``requests`` are (tree, place); None asks for every leaf.
    """
    starts = cut(starts)
    highest = starts.agg(F.max("height")).first()[0] or 0
    asked = []
    if requests is not None:
        now = cut(requests.select("tree", "place").distinct())
        for _ in range(highest):
            up, digit = F.floor(F.col("place") / FAN).cast("long").alias("up"), (F.col("place") % FAN).cast("int")
            asked.append(now := cut(now.groupBy("tree", up).agg(F.collect_set(digit).alias("digits")).withColumnRenamed("up", "place")))
    first = lambda h: starts.where(F.col("height") == h).select("tree", F.lit(0).cast("long").alias("place"), "digest", "path")
    front = first(highest)
    for h in range(highest, 0, -1):
        # equal subtrees have one record
        known = records.where(F.col("height") == h).groupBy("digest").agg(F.first("children").alias("children"))
        front = front.join(known, "digest")
        if requests is None:
            front = front.withColumn("digits", F.sequence(F.lit(0), F.size("children") - 1))
        else:
            front = front.join(asked[h - 1], ["tree", "place"])
        front = front.select("tree", "place", "path", "children", F.explode("digits").alias("digit"))
        others = F.concat(F.slice("children", F.lit(1), F.col("digit")), F.slice("children", F.col("digit") + 2, F.lit(FAN)))
        segment = F.struct("digit", others.alias("others"))
        front = front.select("tree", (F.col("place") * FAN + F.col("digit")).alias("place"), F.element_at("children", F.col("digit") + 1).alias("digest"), F.concat("path", F.array(segment)).alias("path"))
        front = front.union(first(h - 1))
        if h % 4 == 1:
            front = cut(front)
    return front if requests is None else front.join(requests.select("tree", "place").distinct(), ["tree", "place"], "left_semi")


def proofs(m: Manifest, requests: DataFrame | None = None) -> DataFrame:
    """The manifest's leaves with ``subroot``, ``root`` (binary) and ``path``: segments from the leaf up, each the leaf's digit among its run
    and the digests of the others. ``requests`` (tree, place) picks leaves; None takes all."""
    wanted = None if requests is None else m.subroots.join(requests.select("tree").distinct(), "tree").select(F.lit("").alias("tree"), "place")
    # one row for each source
    upper = descend(m.top_records, m.root.select("tree", "height", "digest", F.array().cast(PATH).alias("path")), wanted)
    upper = upper.select("place", "path").join(m.subroots.select("tree", "place", "height", "digest"), "place")
    starts = cut(upper.select("tree", "height", "digest", "path"))
    below = descend(m.records, starts, requests).select("tree", "place", F.reverse("path").alias("path"))
    tops = starts.select("tree", F.col("digest").alias("subroot")).crossJoin(F.broadcast(m.root.select(F.col("digest").alias("root"))))  # the root is one row
    rows = m.leaves.join(below, ["tree", "place"])
    return rows.join(tops, "tree")


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest (text) and a path's segments from the leaf up."""
    join = lambda a: F.array_join(F.transform(a, text_of), "")
    step = lambda below, s: F.sha2(F.concat(join(F.slice(s["others"], F.lit(1), s["digit"])), below, join(F.slice(s["others"], s["digit"] + 1, F.lit(FAN)))), 256)
    return F.aggregate(path, leaf, step)


def siblings(path: Column) -> Column:
    """The digest of all others of a path, level by level from the leaf up."""
    return F.sha2(F.array_join(F.transform(F.flatten(F.transform(path, lambda s: s["others"])), text_of), ""), 256)


def tampered(doc_id: Column, text: Column) -> Column:
    """The text without line feeds where 2 divides the crc32 of the id's decimals; null ids and texts stay."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def verified(docs: DataFrame, *, levels: int = LEVELS) -> DataFrame:
    """Each row's leaf, subroot, root, digest of its siblings, and the root recomputed from the row as ``tampered`` leaves it.

    Null values of any column, empty texts, repeated rows and null sources are leaves like others; an empty table gives an empty one.
    """
    seen = {"seen": F.unhex(leaf_of([F.col(c) if c != "text" else tampered(F.col("doc_id"), F.col("text")) for c in FIELDS]))}
    found = proofs(manifest(docs, also=seen, levels=levels))
    found = found.select("doc_id", text_of(F.col("digest")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), text_of(F.col("root")).alias("root"), siblings(F.col("path")).alias("proof_sha256"), folded(text_of(F.col("seen")), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
