"""SimHash fingerprints and near-duplicate groups found with pivot distance tables.

A fingerprint has one bit per position that is set in over half of the XXH64 values of a text's word shingles.
Fingerprints within ``radius`` bits are linked. Only distinct fingerprints are compared, so copies cost nothing.

Two fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of ``blocks`` bit blocks, so each
fingerprint is dealt to one bucket per choice of that many blocks and no link is lost. A bucket is searched with a
pivot table: the Hamming distances to many reference fingerprints. By the triangle inequality a pair whose coordinates
differ by more than ``radius`` anywhere can't be linked; only the survivors are verified. A bucket over ``bucket_cap``
fingerprints is dealt out as pairs of chunks, and a task returns a spanning forest of the links that it found, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import components, cut, partitions, slices, small_batches, utf8

SEED = 42
PIECE = 1 << 16


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """The fingerprint of one text; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    line, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash64(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    counts = np.zeros((8, 256), np.int64)
    offset = np.arange(8, dtype=np.uint16) * 256
    for at in range(0, n, PIECE):
        s, e = starts[at : min(n, at + PIECE)].tolist(), ends[shingle - 1 :][at : at + PIECE].tolist()
        h = np.fromiter((hash64(line[i:j], SEED) for i, j in zip(s, e)), np.uint64, len(s))
        counts += np.bincount((h.view(np.uint8).reshape(-1, 8) + offset).ravel(), minlength=2048).reshape(8, 256)
    bits = counts @ BITS
    return int.from_bytes(np.packbits((bits * 2 > n).ravel(), bitorder="little").tobytes(), "little")


#: Bit k of each byte value.
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(id, fp long) for every row of ``docs``. A null text has no words and fingerprint 0; ids may be null or repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in utf8(b.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp)], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def _blocks(n: int) -> list[int]:
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [((1 << e) - 1) ^ ((1 << s) - 1) for s, e in zip(edges, edges[1:])]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each of n nodes' component, by repeated minimum and pointer jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def _search(key: np.ndarray, fp: np.ndarray, refs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within runs of equal ``key``."""
    table = np.stack([np.bitwise_count(fp ^ r) for r in refs]).astype(np.int8)
    at, found, step, held = np.arange(len(fp) - 1), [], 1, 0
    root = np.arange(len(fp))
    while len(at):
        at = at[at + step < len(fp)]
        at = at[key[at] == key[at + step]]
        i, j = at, at + step
        for coordinate in table:
            keep = np.abs(coordinate[i] - coordinate[j]) <= radius
            i, j = i[keep], j[keep]
        keep = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        found.append((i[keep], j[keep]))
        held += int(keep.sum())
        if held > 1 << 20:
            root = _roots(len(fp), np.concatenate([root, *(x[0] for x in found)]), np.concatenate([np.arange(len(fp)), *(x[1] for x in found)]))
            found, held = [], 0
        step += 1
    root = _roots(len(fp), np.concatenate([root, *(x[0] for x in found)]), np.concatenate([np.arange(len(fp)), *(x[1] for x in found)])) if len(fp) else root
    linked = np.flatnonzero(root != np.arange(len(fp)))
    return fp[linked], fp[root[linked]]


def links(fps: DataFrame, *, radius: int = 4, blocks: int = 6, pivots: int = 16, bucket_cap: int = 8192) -> DataFrame:
    """(a, b: long) linking all distinct fingerprints ``fp`` of ``fps`` that are joined by steps of at most ``radius`` bits.

    Empty input gives no links; null fingerprints are dropped. Every link is a true one and each group is connected.
    """
    masks = _blocks(blocks)
    refs = np.random.default_rng(SEED).integers(0, 1 << 64, pivots, np.uint64)
    choices = [sum(c) for c in combinations(masks, blocks - radius)]
    one = cut(fps.where("fp is not null").select("fp").distinct())
    keyed = one.select("fp", F.posexplode(F.array(*[F.lit(_signed(m)).bitwiseAND(F.col("fp")) for m in choices])).alias("which", "part"))
    sizes = cut(keyed.groupBy("which", "part").count().where("count > 1"))
    crowded = F.ceil(F.col("count") / bucket_cap).cast("int")
    keyed = keyed.join(sizes, ["which", "part"]).withColumn("chunks", crowded).withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    dealt = keyed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select(F.xxhash64("which", "part", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(key, fp):
            a, b = _search(key, fp.view(np.uint64), refs, radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            key, fp = (np.concatenate([old, batch.column(c).to_numpy()]) for c, old in (("key", key), ("fp", fp)))
            if len(key) >= 1 << 18:
                last = int(np.searchsorted(key, key[-1]))
                if last:
                    yield emit(key[:last], fp[:last])
                    key, fp = key[last:], fp[last:]
        if len(key):
            yield emit(key, fp)

    return dealt.repartition(partitions(fps.sparkSession), "key").sortWithinPartitions("key", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, similar: bool = False, **options) -> DataFrame:
    """(id_col, fp long, component_id): each row's fingerprint and the smallest id of its group of linked fingerprints.

    With ``similar``, texts whose sets of shingles have a Jaccard similarity of at least 0.8 are linked as well, however many bits their
    fingerprints differ in (``jaccard``). Rows with a null id keep their row; their group's smallest id ignores nulls (null if there is no
    other). Null and empty texts have no words and are one group. Empty tables give none, repeated rows one result each, and other
    columns of ``docs`` are ignored.
    """
    small_batches(docs.sparkSession)
    if similar:
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("tk", F.xxhash64("text"))
        fps = jaccard.signatures(texts, shingle, fingerprint)
    else:
        fps = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle))
    first = fps.groupBy("fp").agg(F.min("id").alias("low"))
    groups = components(links(fps, radius=radius))
    rooted = cut(first.join(groups, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "low"))
    if similar:
        wider = components(jaccard.links(fps, texts, rooted.select("fp", "root"), shingle, **options)).select(F.col("node").alias("root"), F.col("root").alias("wider"))
        rooted = cut(rooted.join(wider, "root", "left").select("fp", F.coalesce("wider", "root").alias("root"), "low"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
