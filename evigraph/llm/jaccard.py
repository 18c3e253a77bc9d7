"""Links between texts whose sets of word shingles have a Jaccard similarity of at least 0.8; no such pair is missed by the join.

A part of the SimHash operator: fingerprints of 64 bits within a radius that keeps all such pairs can't be told from those of unlike
texts, so ``simhash.near_duplicates`` adds these links to the ones that it finds by fingerprint.

A set is sorted by one order of all shingles. Two sets of n >= m shingles that are similar enough share at least ``ceil(4 (n + m) / 9)`` of
them, so they share one within the first ``n - ceil(4 n / 5) + 1`` of the larger and the first ``m - ceil(8 m / 9) + 1`` of the smaller set
(prefix filter), with enough shingles behind it in both (position filter). Spark joins the sets by these shingles, and each pair that is
left is checked with its whole sets. The order puts shingles last that are frequent in a sample of the texts; any order gives the same pairs.

Before whole sets are compared, all shared shingles of a pair's prefixes are counted: what both sets hold up to the last of them beside
these is in one set only, which rules out most pairs that share a passage and nothing else. Only sets of different groups are
compared. In a crowded bucket all sets are first checked against a few of them, if their fingerprints differ in ``RADIUS`` bits at
most, and only pairs that these links do not join already are listed, so that a large group of near copies does not list all of its
pairs. Every row of a bucket brings its set's sketch along, so that pairs which it rules out are never listed. Of the listed pairs each set's most promising one is compared first, and then those that are still between two groups. These
choices lose no link: what they leave out is compared later, or joined already.

Whole sets are only sent for pairs whose marks allow a link. A mark has a bit for each remainder of the hashes, set if an odd number of
a set's shingles have it. Each bit in which two marks differ takes a shingle that is in one set only, so marks never differ more than sets.
A sketch is the mark by ``64 * SKETCH`` remainders, whatever the size of the set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, make_room, partitions, slices, union, utf8, written

SEED = 42
PIECE = 1 << 16
#: Texts in the sample that the order of shingles comes from, and how many frequent shingles the order knows.
SAMPLE, FREQUENT = 20_000, 200_000
PIVOTS = 4
RADIUS, FEW = 24, 20
#: Set keys that a task remembers to write a prefix once; beyond it, equal sets are written again, which changes no pair.
MET = 1 << 18
#: Longs of a sketch. Sets of up to some 1,000 shingles that share little are told apart by them.
SKETCH = 8
SKETCHED = [f"s{i}" for i in range(SKETCH)]
#: Words of the bit map in ``_screened``.
SCREEN = 1 << 17


def shingles(text: bytes, size: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, ascending; a shorter text is one shingle, no words give none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    line, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([hash64(line, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - size + 1
    found = []
    for at in range(0, n, PIECE):
        s, e = starts[at : min(n, at + PIECE)].tolist(), ends[size - 1 :][at : at + PIECE].tolist()
        found.append(np.fromiter((hash64(line[i:j], SEED) for i, j in zip(s, e)), np.uint64, len(s)))
    return np.unique(np.concatenate(found))


def _set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED)


def _prefix(hashes: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the common order: others by hash, then the frequent ones (sorted, with their ranks)."""
    n = len(hashes)
    keep = n - (4 * n + 4) // 5 + 1 if n else 0
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        known = frequent[at] == hashes
        if known.any():
            late = hashes[known][np.argsort(rank[at[known]], kind="stable")]
            hashes = np.concatenate((hashes[~known], late))
    return hashes[:keep]


def _mark(hashes: np.ndarray) -> bytes:
    """The parity of how many shingles have each remainder. There are 1 to 2 remainders a shingle: a power of two, at least 64."""
    size = max(64, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """The parity of how many shingles have each of ``64 * SKETCH`` remainders, as longs."""
    size = 64 * SKETCH
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _apart(x: bytes, y: bytes) -> int:
    """The bits in which two marks differ, once the longer one is folded to the other's remainders; at most the shingles in one set only."""
    short, long = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    folded = np.bitwise_xor.reduce(long.reshape(-1, len(short)), axis=0)
    return int(np.bitwise_count(folded ^ short).sum())


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _frequent(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several of about ``SAMPLE`` different texts hold, ascending, and their rank by frequency. Only the order rests on them."""
    every = -(-max(1, texts.count()) // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for t in utf8(b.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, size).view(np.int64))], names=["h"])

    some = texts.where(F.pmod(F.col("tk"), F.lit(every)) == 0).dropDuplicates(["tk"]).select("text").mapInArrow(run, "h long")
    top = some.groupBy("h").count().where("count > 2").orderBy(F.desc("count"), "h").limit(FREQUENT).select("h").toArrow()
    h = top.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h)
    return h[order], (len(h) - np.arange(len(h)))[order].astype(np.int32)


def _candidates(rows: DataFrame, cap: int) -> DataFrame:
    """Distinct pairs (a, b) of different groups ``comp`` among rows (key, sk, n, pos, comp, size, sketch) of equal keys that pass the
    filters, and how many keys they share.

    All shared keys of a pair's prefixes are counted. Up to the last of them, what a set holds beside the counted ones is not in the
    other set, as both are in one order; so the count and what lies behind that place bound how much the sets can share.
    """
    chunks = F.ceil(F.col("size") / cap).cast("int")
    dealt = rows.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("sk"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    names = ["deal", "sk", "n", "pos", "comp", "chunk", "mixed", *SKETCHED]
    dealt = dealt.select(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("deal"), "sk", "n", "pos", "comp", "chunk", (F.col("chunk") != F.col("other")).cast("int").alias("mixed"), *SKETCHED)

    def summed(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        a, b, na, nb, pos_a, pos_b, near = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((b, a))
        a, b, na, nb, pos_a, pos_b, near = (x[order] for x in (a, b, na, nb, pos_a, pos_b, near))
        starts = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        count = np.diff(np.append(starts, len(a)))
        most = [np.maximum.reduceat(x, starts) for x in (pos_a, pos_b, near)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (a[starts], b[starts], na[starts], nb[starts], count, *most)], names=["a", "b", "na", "nb", "shared", "pos_a", "pos_b", "near"])

    def pairs(deal, sk, n, pos, comp, chunk, mixed, *sketch):
        # a set that several tasks wrote counts once
        once = np.concatenate(([True], (deal[1:] != deal[:-1]) | (sk[1:] != sk[:-1])))
        deal, sk, n, pos, comp, chunk, mixed, *sketch = (x[once] for x in (deal, sk, n, pos, comp, chunk, mixed, *sketch))
        at, step, out, held = np.arange(len(deal)), 1, [], 0
        while len(at):
            at = at[at + step < len(deal)]
            at = at[deal[at] == deal[at + step]]
            i, j = at, at + step
            # rows are sorted by size, so j is the larger set; two sets of one chunk meet where only this chunk is
            keep = (comp[i] != comp[j]) & (5 * n[i] >= 4 * n[j]) & ((mixed[i] == 0) | (chunk[i] != chunk[j]))
            i, j = i[keep], j[keep]
            apart = np.zeros(len(i), np.int64)
            for x in sketch:
                apart += np.bitwise_count(x.view(np.uint64)[i] ^ x.view(np.uint64)[j])
            keep = 9 * apart <= n[i] + n[j]
            i, j = i[keep], j[keep]
            least = (4 * (n[i] + n[j]) + 8) // 9
            near = (pos[i] <= n[i] - (8 * n[i] + 8) // 9) & (n[i] - pos[i] >= least) & (n[j] - pos[j] >= least)
            if len(i):
                out.append([sk[i], sk[j], n[i], n[j], pos[i], pos[j], near.astype(np.int64)])
                held += len(i)
            if held > 1 << 19:
                yield summed(out)
                out, held = [], 0
            step += 1
        if out:
            yield summed(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            new = [batch.column(c).to_numpy() for c in names]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if len(held[0]) >= 1 << 17:
                last = int(np.searchsorted(held[0], held[0][-1]))
                if last:
                    yield from pairs(*(x[:last] for x in held))
                    held = [x[last:] for x in held]
        if held is not None and len(held[0]):
            yield from pairs(*held)

    schema = "a long, b long, na long, nb long, shared long, pos_a long, pos_b long, near long"
    found = dealt.repartition(partitions(rows.sparkSession), "deal").sortWithinPartitions("deal", "n", "sk").mapInArrow(run, schema)
    found = found.groupBy("a", "b", "na", "nb").agg(F.sum("shared").alias("shared"), *(F.max(c).alias(c) for c in ("pos_a", "pos_b", "near")))
    behind = F.least(F.col("na") - F.col("pos_a"), F.col("nb") - F.col("pos_b")) - 1
    return found.where((F.col("near") == 1) & (9 * (F.col("shared") + behind) >= 4 * (F.col("na") + F.col("nb")))).select("a", "b", "shared")


def _allowed(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) of set keys without those whose marks differ in more bits than similar sets differ in shingles."""

    columns = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(iter([whole]), "x"):
                both = zip(b.column("x").to_pylist(), b.column("y").to_pylist(), b.column("nx").to_pylist(), b.column("ny").to_pylist())
                keep = [9 * _apart(x, y) <= nx + ny for x, y, nx, ny in both]
                yield b.select(columns).filter(pa.array(keep, pa.bool_()))

    marks = rows.where("mark is not null").dropDuplicates(["sk"])
    left, right = (marks.select(F.col("sk").alias(k), F.col("n").alias(f"n{c}"), F.col("mark").alias(c)) for k, c in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, pairs.schema)


def _screened(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``texts`` without most of those whose ``tk`` is not ``wanted``, before they are shuffled; a bit map of 1 MB at any input size.

    No wanted text goes: all of them have their bit set.
    """
    bit = f"pmod(tk, {SCREEN * 64}L)"
    words = wanted.selectExpr(f"{bit} div 64 as at", f"shiftleft(1L, cast({bit} % 64 as int)) as bits")
    some = words.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(SCREEN, np.uint64)
    table[some.column("at").to_numpy()] = some.column("bits").to_numpy().view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("tk").to_numpy() % (SCREEN * 64)
            yield b.filter(pa.array((table[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1))

    return texts.select("tk", "text").mapInArrow(run, "tk long, text string")


def _verified(pairs: DataFrame, texts: DataFrame, first: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) of set keys whose whole sets are similar enough; ``first`` names a text for each set."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [shingles(t, size) for t in utf8(b.column("text"))]
            yield pa.RecordBatch.from_arrays([_longs([_set_key(h) for h in found]), pa.array([h.tobytes() for h in found], pa.binary())], names=["sk", "hs"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(iter([whole]), "x"):
                keep = []
                for x, y in zip(b.column("x"), b.column("y")):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                    shared = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(9 * shared >= 4 * (len(x) + len(y)))
                yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("sk")).union(pairs.select("b")).distinct().join(first, "sk").select("tk").distinct()
    wanted = cut(wanted)
    whole = cut(_screened(texts, wanted).join(wanted, "tk", "left_semi").dropDuplicates(["tk"]).select("text").mapInArrow(sets, "sk long, hs binary"))
    left, right = whole.select(F.col("sk").alias("a"), F.col("hs").alias("x")), whole.select(F.col("sk").alias("b"), F.col("hs").alias("y"))
    return cut(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"))


def signatures(texts: DataFrame, size: int, fingerprint: Callable[[bytes, int], int]) -> DataFrame:
    """(row, id, fp, tk, sk, n, prefix, mark, sketch) of each text: its fingerprint, text key, set key, number of shingles, the shingles
    that are joined and the set's mark and sketch (null where the task has met the same set before). Rows are written, so that ``row``
    stays what it is."""
    frequent, rank = _frequent(texts.select("tk", "text"), size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        met: set[int] = set()
        for b in slices(batches):
            fps, keys, counts, prefixes, marks, sketches = [], [], [], [], [], []
            for t in utf8(b.column("text")):
                h = shingles(t, size)
                fps.append(fingerprint(t, size))
                keys.append(_set_key(h))
                counts.append(len(h))
                new = keys[-1] not in met
                prefixes.append(_prefix(h, frequent, rank).view(np.int64) if new else None)
                marks.append(_mark(h) if new else None)
                sketches.append(_sketch(h).tolist() if new else None)
                if len(met) < MET:
                    met.add(keys[-1])
            columns = [b.column("id"), _longs(fps), b.column("tk"), _longs(keys), pa.array(counts, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(marks, pa.binary())]
            each = [pa.array([None if x is None else x[i] for x in sketches], pa.int64()) for i in range(SKETCH)]
            yield pa.RecordBatch.from_arrays(columns + each, names=["id", "fp", "tk", "sk", "n", "prefix", "mark", *SKETCHED])

    found = texts.mapInArrow(run, "id long, fp long, tk long, sk long, n long, prefix array<long>, mark binary, " + ", ".join(f"{c} long" for c in SKETCHED))
    return written(found.withColumn("row", F.monotonically_increasing_id()), "signatures")


def links(rows: DataFrame, texts: DataFrame, groups: DataFrame, size: int, *, crowded: int = 16, cap: int = 2048) -> DataFrame:
    """(a, b): groups that a link of similar sets joins. rows: ``signatures``; groups: (fp, root), the group of each fingerprint."""
    same = [F.min(c).alias(c) for c in SKETCHED]  # of all texts of a set; nulls don't count
    known = rows.groupBy("sk", "fp").agg(F.max("n").alias("n"), *same).join(groups, "fp").groupBy("sk")
    known = cut(known.agg(F.min("root").alias("root"), F.max("root").alias("other"), F.min("fp").alias("fp"), F.max("n").alias("n"), *same))
    equal = known.where("root != other").select(F.col("root").alias("a"), F.col("other").alias("b"))
    first = rows.groupBy("sk").agg(F.min_by("tk", "row").alias("tk"))
    # the place in a prefix and the size of the set as one number
    packed = (F.col("n") * F.lit(1 << 31) + F.col("pos")).alias("np")
    keyed = rows.where("prefix is not null").select("sk", "n", F.posexplode("prefix").alias("pos", "key")).select("key", "sk", packed)
    # most keys are in one set, or in copies of one that several tasks wrote; these rows move once
    over = Window.partitionBy("key")
    shared = keyed.withColumns({"size": F.count("*").over(over), "low": F.min("sk").over(over), "high": F.max("sk").over(over)}).where("low != high")
    shared = cut(shared.select("key", "sk", F.expr(f"np div {1 << 31}L").alias("n"), F.expr(f"np % {1 << 31}L").alias("pos"), "size"))
    sets = known.select("sk", F.col("root").alias("comp"), "fp", *SKETCHED)
    hot, joined = shared.where(F.col("size") > crowded), None
    if hot.take(1):
        near = cut(_allowed(_near(hot.select("key", "sk", "n").join(sets, "sk")), rows))
        joined = cut(_between(_verified(near, texts, first, size), known))
        rooted = components(joined).select(F.col("node").alias("comp"), "root")
        sets = cut(sets.join(rooted, "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root"))
    shared = shared.join(sets.drop("fp"), "sk")
    # each set's most promising pair first: what these join need not be compared again
    pairs = cut(_allowed(_candidates(shared, cap), rows))
    best = [pairs.groupBy(x).agg(F.max_by(y, F.struct("shared", y)).alias(y)).select("a", "b") for x, y in ("ab", "ba")]
    best = cut(best[0].union(best[1]).distinct())
    likely = cut(_between(_verified(best, texts, first, size), known))
    rooted = components(likely if joined is None else likely.union(joined)).select(F.col("node").alias("root"), F.col("root").alias("wider"))
    now = cut(known.select("sk", "root").join(rooted, "root", "left").select("sk", F.coalesce("wider", "root").alias("root")))
    a, b = (now.select(F.col("sk").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
    rest = pairs.select("a", "b").join(best, ["a", "b"], "left_anti").join(a, "a").join(b, "b").where("a_root != b_root").select("a", "b")
    rest = _between(_verified(cut(rest), texts, first, size), known)
    return union([x for x in (equal, joined, likely, rest) if x is not None])


def _near(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of set keys of different groups among rows (key, sk, n, comp, fp, sketch): those of a set and one of the few
    that stand for its bucket that are likely links by fingerprint, size and sketch.

    Fingerprints of sets of a similarity of 0.8 differ in 10 bits, give or take 3, if no shingle is repeated much. Pairs that are left out
    here are compared later.
    """
    over, fields = Window.partitionBy("key"), ["sk", "n", "comp", "fp", *SKETCHED]
    part = F.pmod(F.xxhash64("sk"), F.lit(PIVOTS))
    pivots = F.array(*(F.min(F.when(part == p, F.struct(*fields))).over(over) for p in range(PIVOTS)))

    def likely(p):
        bits = lambda c: F.bit_count(F.col(c).bitwiseXOR(p[c]))
        apart = sum((bits(c) for c in SKETCHED[1:]), bits(SKETCHED[0]))
        alike = (bits("fp") <= RADIUS) | (F.least("n", p["n"]) < FEW)
        sized = 5 * F.least("n", p["n"]) >= 4 * F.greatest("n", p["n"])
        return p.isNotNull() & (F.col("comp") != p["comp"]) & sized & alike & (9 * apart <= F.col("n") + p["n"])

    found = rows.withColumn("pivots", pivots).select("sk", F.explode(F.transform(F.filter("pivots", likely), lambda p: p["sk"])).alias("p"))
    return found.select(F.least("sk", "p").alias("a"), F.greatest("sk", "p").alias("b")).distinct()


def _between(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of set keys as pairs of their groups."""
    a, b = (known.select(F.col("sk").alias(c), F.col("root").alias(f"{c}_root")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct()
