"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing and token output, one stage after the other.

A stage takes (spark, docs, sf_dir), works on every row that the stage before it kept, and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.llm import decontaminate, mixing, simhash, tokens, toxicity
from evigraph.llm.common import cut, new_path


#: Bits of the map of rows that near_dedup looks at again.
BITS = 1 << 23


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go.

    Null and empty texts score like no evidence and stay, unless labels make that toxic; rows of equal texts, also of one id, go or stay
    together; null ids stay like others but teach nothing. Without labels of both classes all rows stay; an empty table stays empty.
    """
    return toxicity.accepted(docs, _table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: the one with the smallest id, and of several such the one with the smallest hash.

    Near duplicates are linked by SimHash fingerprints of 5-word shingles and by a Jaccard similarity of these of 0.8 or more. Different
    texts that share an id are rows of their own; rows without an id come last within their group; null and empty texts are one group.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), F.xxhash64("doc_id", "text").alias("key")).groupBy("doc_id", "hash", "key").agg(F.count("*").alias("n"))
    groups = simhash.near_duplicates(docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text"), shingle=5, similar=True).distinct()
    named = cut(rows.join(groups.withColumnRenamed("doc_id", "key"), "key").select("doc_id", "hash", "n", "component_id"))
    best = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hash")).alias("best")).select("best.doc_id", "best.hash")
    best = cut(best)
    same = F.expr("d.doc_id <=> b.doc_id and d.hash = b.hash")
    # rows that go, or stand more than once, are marked in a bit map of 1 MB at any input size; what has no mark stays as it is
    marked = named.alias("d").join(best.alias("b"), same, "left_anti").select("doc_id", "hash").union(named.where("n > 1").select("doc_id", "hash"))
    place = F.pmod(F.xxhash64("doc_id", "hash"), F.lit(BITS))
    bits = marked.groupBy(F.floor(place / 64).alias("_at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id, hash), {BITS}L) % 64 as int))")).alias("_bits"))
    seen = docs.withColumn("_hash", F.xxhash64("text")).withColumn("_place", F.pmod(F.xxhash64(F.col("doc_id").cast("long"), "_hash"), F.lit(BITS)))
    seen = seen.withColumn("_at", F.floor(F.col("_place") / 64)).join(F.broadcast(bits), "_at", "left")  # at most BITS / 64 rows
    hit = F.coalesce(F.expr("(_bits & shiftleft(1L, cast(_place % 64 as int))) != 0"), F.lit(False))
    once = seen.where(hit).alias("d").join(best.alias("b"), F.expr("d.doc_id <=> b.doc_id and d._hash = b.hash"), "left_semi")
    nth = F.row_number().over(Window.partitionBy("doc_id", "_hash").orderBy(F.lit(0)))
    return seen.where(~hit).select(*docs.columns).union(once.withColumn("_nth", nth).where("_nth = 1").select(*docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go.

    Null and empty texts have no words and stay; equal rows go or stay together, whatever their ids; of a very long text every word is
    looked at, and one window anywhere is enough. An empty table, or an empty benchmark, takes nothing away.
    """
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each document and round that takes words of it.

    Null and empty texts have no words to take and get no row; a null source is a source of its own, null ids come first in its stream, and
    equal rows are parts of the stream of their own. A very long text is cut where a block ends. An empty table gives an empty one.
    """
    return mixing.mixed(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and per row of it what was read back from them.

    Rows are laid out by id, nulls first, equal ids by text; null and empty texts are the end id alone, and equal rows have their tokens
    each. A text longer than a block makes a block of its own. An empty table gives an empty one.
    """
    return tokens.digest(tokens.token_files(docs))


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("tokens", token_stage),
]

#: No SQL expresses the models of the first stage; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written to a fresh folder below the shared one."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
