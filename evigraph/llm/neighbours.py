"""Nearest neighbours by an adaptive scan of dimensions in probed lists.

Vectors are turned by a random rotation and kept in lists around centroids. A query reads the lists of the nearest centroids block of
columns by block of columns: after each block a hypothesis test on the partial distance abandons the candidates that are too far with
near certainty, and only survivors are measured exactly, in double precision on the original vectors. Lists are cut into parts of at
most ``part_rows`` vectors and the queries into blocks of ``query_rows``, so a task holds one part and one block of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SEED = 11
SAMPLE_ROWS = 16384
LIST_ROWS = 1024
MOST_LISTS = 4096
PROBED = 0.6
PART_ROWS = 8192
QUERY_ROWS = 2048
COLUMNS = 8
#: Significance of the test: a candidate goes if its partial distance is this many deviations over its share of the limit.
DEVIATIONS = 3.0
CHUNK = 1024


def valid(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id long, v array<float>) of the vectors that take part: not null or zero, only finite components, and of the commonest
    length (the smallest of equally common ones); rows with a null id take no part."""
    v = F.col(vector_col).cast("array<double>")
    usable = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(usable & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common.n if common else 0))


def rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Lloyd's rounds from evenly drawn seeds; empty lists keep their centre."""
    c = sample[np.random.default_rng(SEED).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        near = nearest(sample, c, 1)[:, 0]
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k nearest centroids of each row, nearest first."""
    out = []
    for at in range(0, len(x), 4096):
        d = (c * c).sum(1) - 2 * x[at : at + 4096] @ c.T
        part = np.argpartition(d, min(k, len(c)) - 1, axis=1)[:, :k]
        out.append(np.take_along_axis(part, np.argsort(np.take_along_axis(d, part, 1), axis=1, kind="stable"), 1))
    return np.concatenate(out) if out else np.empty((0, k), np.int64)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def scan(q: np.ndarray, own: int, turned: np.ndarray, query: np.ndarray, original: np.ndarray, ids: np.ndarray, k: int, known: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest of one part to one query, ties to the smaller id. turned, q: rotated; query, original: not.
    known: a distance that the k nearest of all don't exceed."""
    d = turned.shape[1]
    best_id, best_d = np.empty(0, np.int64), np.empty(0)
    for at in range(0, len(ids), CHUNK):
        alive = np.flatnonzero(ids[at : at + CHUNK] != own) + at
        limit = min(known, best_d[k - 1] if len(best_d) == k else np.inf)
        partial = np.zeros(len(alive))
        for c in range(0, d, COLUMNS):
            end = min(d, c + COLUMNS)
            partial += ((turned[alive, c:end] - q[c:end]) ** 2).sum(1)
            if np.isfinite(limit):
                # the share of the squared distance in `end` of d random directions, and how far it may stray
                bound = limit * limit * (end / d) * (1 + DEVIATIONS * np.sqrt(2 / end * (1 - end / d))) ** 2 + 1e-9
                keep = partial <= bound
                alive, partial = alive[keep], partial[keep]
                if not len(alive):
                    break
        if len(alive):
            exact = np.sqrt(((original[alive] - query) ** 2).sum(1))
            best_id, best_d = np.concatenate((best_id, ids[alive])), np.concatenate((best_d, exact))
            order = np.lexsort((best_id, best_d))[:k]
            best_id, best_d = best_id[order], best_d[order]
    return best_id, best_d


def neighbours(vectors: DataFrame, *, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", probed: float = PROBED, list_rows: int = LIST_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """(query_id, rank, id_col, score) of the ``k`` nearest other rows for each row whose id is divisible by ``every``.

    Centroids are fitted on a sample of at most ``SAMPLE_ROWS`` rows (those with the smallest hashes); all rows are indexed. ``probed``
    is the share of the lists that a query reads. Rows that share an id are candidates of their own, but not for their id's query,
    which is asked once, with the smallest vector. Vectors that are null, zero or hold a null or non-finite component, and rows with a
    null id, take no part. Equal distances go to the smaller id, and then count as ranks of their own; equal vectors are neighbours at
    distance 0. Columns beside the id and the vector are ignored, whatever their names. An empty table, or one without usable vectors,
    gives no rows.
    """
    rows = cut(valid(vectors, id_col=id_col, vector_col=vector_col))
    n = rows.count()
    spark, none = rows.sparkSession, "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], none).withColumnRenamed("vec_id", id_col)
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").select("v").limit(SAMPLE_ROWS).collect()])
    turn = rotation(sample.shape[1])
    lists = int(min(MOST_LISTS, max(1, n // list_rows), len(sample)))
    centres = centroids(sample @ turn, lists)
    probes = max(min(8, lists), round(lists * probed))
    shared = spark.sparkContext.broadcast((turn, centres))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, centres = shared.value
        for b in batches:
            if b.num_rows:
                near = nearest(matrix(b.column("v")) @ turn, centres, probes if "wanted" in b.schema.names else 1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["id", "v", "near"])

    kind = "id long, v array<double>, near array<int>"
    held = cut(rows.mapInArrow(place, kind).select("id", "v", F.col("near")[0].alias("list")))
    asked = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")).withColumn("wanted", F.lit(True))
    asked = cut(asked.mapInArrow(place, kind).select("id", "v", F.posexplode("near").alias("nth", "list")))
    parts = held.groupBy("list").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("parts"))
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    sizes = F.broadcast(parts.join(blocks, "list"))  # a row for each list, of which there are at most MOST_LISTS
    asked = asked.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = held.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        turn, _ = shared.value
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            original, ids = matrix(right.column("v").combine_chunks()), right.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            original, ids = original[order], ids[order]
            turned, queries = original @ turn, matrix(left.column("v").combine_chunks())
            for own, query, known in zip(left.column("id").to_pylist(), queries, left.column("known").to_pylist()):
                found, d = scan(query @ turn, own, turned, query, original, ids, k, known)
                out += zip([own] * len(found), found.tolist(), d.tolist())
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    key = ["list", "part", "block"]
    held = held.select(*key, "id", "v")

    def searched(queries: DataFrame) -> DataFrame:
        pairs = queries.select(*key, "id", "v", "known").groupBy(*key).cogroup(held.groupBy(*key))
        return pairs.applyInArrow(search, "query_id long, id long, score double")

    # the nearest list first: its k-th distance is a limit for all others
    near = cut(searched(asked.where("nth = 0").withColumn("known", F.lit(float("inf")))))
    limits = near.groupBy("query_id").agg(F.array_sort(F.collect_list("score")).alias("d")).select("query_id", F.when(F.size("d") >= k, F.get("d", F.lit(k - 1))).alias("limit"))
    rest = asked.where("nth > 0").join(limits, asked["id"] == limits["query_id"], "left").withColumn("known", F.coalesce("limit", F.lit(float("inf"))))
    found = near.unionByName(searched(rest))
    best = Window.partitionBy("query_id").orderBy("score", "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
