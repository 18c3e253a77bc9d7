"""Mixing sources to target weights, with DataFrame functions only.

The words of a source form one stream in id order, packed into blocks of ``block`` words. The mix is a sequence of slots of one block
each, cut into output shards of ``shard_slots``. A source owns as many slots as its target asks for: whole passes over its blocks, then
blocks of a part of one more pass, the last of them cut to the word, so that its words come within one block of its target. Slots are
numbered through a pseudorandom permutation and each source owns a range of the numbers; so a shard's source counts are a multinomial
draw conditioned on the totals (multivariate hypergeometric): they vary by shard as a draw does, and the totals meet the targets. A
slot's number within its source is mapped through a pseudorandom permutation of the source's block indexes, another one for each pass,
and blocks are joined by source and index.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

WEIGHTS = (3, 1, 2)
BLOCK = 64
SHARD_SLOTS = 4096
MOST = 2
WORD = r"[^\x20\x09-\x0D]+"
PASSES, ROUNDS = 2, 6


def size_of(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def digits(n: Column) -> tuple[Column, Column]:
    """(low, high) for ``permuted``: about the root of n, and how many times it goes into n. n is 1 at least."""
    low = F.greatest(F.lit(1), F.floor(F.sqrt(n))).cast("long")
    return low, F.floor(n / low).cast("long")


def permuted(x: Column, n: Column, low: Column, high: Column, *seed: Column) -> Column:
    """A pseudorandom permutation of 0..n-1 drawn by ``seed``, at ``x``. ``low`` and ``high`` are the ``digits`` of n; n and they should be
    columns of the table or literals, as they are read in each of the steps.

    A pass turns the numbers by a keyed shift and reads those below ``low * high`` (all but a few) as two digits. In each round one digit
    is shifted by a keyed function of the other one, which can be undone, so different numbers stay different.
    """

    def step(x: Column, r: Column) -> Column:
        a, b = x % low, F.floor(x / low)
        turned = (x + F.pmod(F.xxhash64(*seed, r), n)) % n
        one = b * low + (a + F.pmod(F.xxhash64(*seed, r, b), low)) % low
        other = ((b + F.pmod(F.xxhash64(*seed, r, a), high)) % high) * low + a
        return F.when(r % (ROUNDS + 1) == 0, turned).when(x >= low * high, x).when(r % 2 == 0, one).otherwise(other)

    return F.aggregate(F.sequence(F.lit(0), F.lit(PASSES * (ROUNDS + 1) - 1)), x.cast("long"), step)


def targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, get the weights in turn and share ``share`` times all sizes; a target stops at ``most``
    times its source's size and the excess is reshared by weight. That is the level at which the targets of the sources below their
    limit are proportional to their weights, found in order of limit by weight. There is one row for each source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight.cast("double")).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    rising = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    below, rest = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    w = w.withColumn("level", (total - F.coalesce(F.sum("limit").over(below), F.lit(0.0))) / F.sum("weight").over(rest))
    # the first source that stays below its limit fixes the level for itself and all after it
    w = w.withColumn("free", F.col("level") * F.col("weight") <= F.col("limit")).withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), "level"))).over(everything)["level"])
    return w.select("source", "source_size", F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("level") * F.col("weight"))).alias("target"))


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` (source, doc_id, text hash, size) with the place of each row's first word in the stream of its source.

    Rows are dealt in ranges of about equal numbers of rows; prefix sums are taken within each range and source, and over the ranges' sums.
    """
    order = [F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("size")]
    docs = cut(docs.repartitionByRange(partitions(docs.sparkSession), *order).withColumn("part", F.spark_partition_id()))
    sums = docs.groupBy("source", "part").agg(F.sum("size").alias("words"))
    above = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.coalesce(F.sum("words").over(above), F.lit(0)))
    within = Window.partitionBy("source", "part").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = docs["source"].eqNullSafe(before["source"]) & (docs["part"] == before["part"])
    return docs.join(before, same).select(*(docs[c] for c in docs.columns if c not in ("part", "within")), (F.col("within") + F.col("before")).alias("place"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = MOST, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, slots, pieces) of a mix of ``docs`` (doc_id, text, source).

    documents: doc_id, hash (of the text), source, size, place, source_size, target. slots: shard, slot, source, round, index, limit: the
    block that fills each slot of the mix, and how many words of it at most. pieces: doc_id, hash, source, place, round, first, words:
    which words of a document the blocks of one round take. A block is in ``most`` slots at most. Null sources are a source; null ids
    come first in the stream; equal rows are parts of the stream of their own; an empty table gives three empty ones.
    """
    rows = docs.select("source", F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), size_of(F.col("text")).alias("size"))
    rows = cut(placed(cut(rows)))
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights=weights, share=share, most=most)
    some = F.col("source_size") > 0
    wanted = (
        wanted.withColumns({"aim": F.round("target").cast("long"), "blocks": F.ceil(F.col("source_size") / block).cast("long")})
        .withColumn("passes", F.when(some, F.expr("aim div source_size")).otherwise(0))
        .withColumn("rest", F.when(some, F.expr("aim % source_size")).otherwise(0))
        .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block).cast("long"))
        .withColumn("cut", F.when(F.col("rest") % block > 0, F.col("rest") % block))
        .withColumns({"n": F.greatest("blocks", F.lit(1)), "salt": F.xxhash64(F.lit(seed), F.col("source").isNull(), "source")})
        .withColumns(dict(zip(("n_low", "n_high"), digits(F.greatest("blocks", F.lit(1))))))
    )
    # one row for each source
    wanted = cut(wanted.withColumn("low", F.coalesce(F.sum("slots").over(Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    total = wanted.agg(F.sum("slots")).first()[0] or 0
    # an owner for each run of numbers: the sources' ranges are cut at multiples of a stride to be joined by equality
    stride, n = max(1, total // 4096), max(1, total)
    ranges = wanted.where("slots > 0").withColumn("part", F.explode(F.sequence(F.floor(F.col("low") / stride), F.floor((F.col("low") + F.col("slots") - 1) / stride))))
    slots = cut(docs.sparkSession.range(total).select(F.col("id").alias("slot"), permuted(F.col("id"), F.lit(n), F.lit(isqrt(n)), F.lit(n // isqrt(n)), F.lit(seed)).alias("number")))
    slots = slots.withColumn("part", F.expr(f"number div {stride}"))
    slots = slots.join(ranges, "part").where("number >= low and number < low + slots").withColumn("k", F.col("number") - F.col("low"))
    slots = slots.withColumns({"round": F.expr("k div blocks"), "inside": F.expr("k % blocks"), "limit": F.when(F.col("k") == F.col("slots") - 1, F.col("cut"))})
    slots = slots.withColumn("index", permuted(F.col("inside"), *map(F.col, ("n", "n_low", "n_high", "salt", "round"))))
    slots = slots.select(F.expr(f"slot div {shard_slots}").alias("shard"), (F.col("slot") % shard_slots).alias("slot"), "source", "round", "index", F.coalesce("limit", F.lit(block)).cast("long").alias("limit"))
    spread = F.explode(F.sequence(F.floor(F.col("place") / block), F.floor((F.col("place") + F.col("size") - 1) / block)))
    parts = rows.where("size > 0").withColumn("index", spread)
    same = parts["source"].eqNullSafe(slots["source"]) & (parts["index"] == slots["index"])
    first, end = F.greatest(F.col("place"), parts["index"] * block), F.least(F.col("place") + F.col("size"), parts["index"] * block + F.col("limit"))
    pieces = parts.join(slots, same).where(first < end).select("doc_id", "hash", parts["source"], "place", "round", (first - F.col("place")).alias("first"), (end - first).alias("words"))
    known = rows["source"].eqNullSafe(wanted["source"])
    documents = rows.join(wanted, known).select("doc_id", "hash", rows["source"], "size", "place", "source_size", "target")
    return documents, slots, pieces


def taken(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row: how many of its words the mix takes, repeats counted."""
    documents, _, pieces = mix(docs, **options)
    sums = pieces.groupBy("source", "place").agg(F.sum("words").alias("taken"))
    same = documents["source"].eqNullSafe(sums["source"]) & (documents["place"] == sums["place"]) & (documents["size"] > 0)
    return documents.join(sums, same, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows with the columns of ``docs``: a row for each document and round that takes words of it.

    A document that a round takes whole keeps its text; otherwise its taken words stand in order, joined by spaces. ``n_chars``, if
    there is one, is set to the new length.
    """
    documents, _, pieces = mix(docs, **options)
    runs = pieces.groupBy("source", "place", "round").agg(F.sum("words").alias("words"), F.array_sort(F.collect_list(F.struct("first", "words"))).alias("parts"))
    same = documents["source"].eqNullSafe(runs["source"]) & (documents["place"] == runs["place"]) & (documents["size"] > 0)
    chosen = documents.join(runs, same).select(documents["doc_id"].alias("_id"), documents["hash"].alias("_hash"), documents["source"].alias("_source"), documents["place"].alias("_place"), documents["size"].alias("_size"), F.col("words").alias("_words"), F.col("parts").alias("_parts"))
    # equal rows have equal keys: number them so that each takes the words of one place
    key = ["_id", "_hash", "_source"]
    nth = F.dense_rank().over(Window.partitionBy(*key).orderBy("_place"))
    chosen = chosen.withColumn("_nth", nth)
    rows = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_hash": F.xxhash64("text"), "_source": F.col("source")})
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key).orderBy("_id")))
    match = rows["_nth"] == chosen["_nth"]
    for c in key:
        match &= rows[c].eqNullSafe(chosen[c])
    words = F.regexp_extract_all(rows["text"], F.lit(f"({WORD})"))
    text = F.when(F.col("_words") == F.col("_size"), rows["text"]).otherwise(F.array_join(F.flatten(F.transform("_parts", lambda p: F.slice(words, p["first"].cast("int") + 1, p["words"].cast("int")))), " "))
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.join(chosen, match).select(*(new[c].alias(c) if c in new else rows[c] for c in docs.columns))
