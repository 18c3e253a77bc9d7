"""Conformance of dependencies with layered decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import G, ancestors, ranked

RULE_KINDS = ("imports", "calls", "depends-on")


def layer_of(files: DataFrame, rule: DataFrame) -> DataFrame:
    """(path, layer, rank): the first segment below the rule's root, without ``.rs``, if it is a layer. rule: decision, root, layer, rank.

    A root owns what is below it, so an empty one owns paths that begin with a slash.
    """
    rule = rule.withColumn("root", F.rtrim("root", F.lit("/")))
    # the roots that a path can have are the directories above it
    above = files.select(*G, "path", F.explode(ancestors(F.col("path"))).alias("root")).where(F.col("path").startswith(F.concat("root", F.lit("/"))))
    first = F.split(F.expr("substring(path, length(root) + 2)"), "/")[0]
    named = above.join(rule.select("decision", "root").distinct(), "root").withColumn("layer", F.regexp_replace(first, r"\.rs$", ""))
    return named.join(rule, ["decision", "root", "layer"]).select(*G, "decision", "path", "layer", "rank")


def layer_violations(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Dependency edges (src, dst, kind) from a later to an earlier layer of a decision."""
    a, b = (layers.select(*G, "decision", F.col("path").alias(e), F.col("layer").alias(f"{e}_layer"), F.col("rank").alias(f"{e}_rank")) for e in ("src", "dst"))
    rows = edges.where(F.col("kind").isin(*RULE_KINDS)).select(*G, "src", "dst").distinct().join(a, [*G, "src"]).join(b, [*G, "decision", "dst"])
    return rows.where("dst_rank < src_rank").select(*G, "decision", "src", "dst", "src_layer", "dst_layer")


def audit_decisions(decisions: DataFrame, violations: DataFrame, inspected: DataFrame) -> DataFrame:
    """(decision, outcome, confidence, violations). decisions: decision, status, binding; inspected: decision, n."""
    v = violations.groupBy("decision").agg(F.count("*").alias("violations"))
    rows = decisions.join(v, "decision", "left").join(inspected, "decision", "left").withColumn("violations", F.coalesce("violations", F.lit(0)))
    case = F.when(F.col("status").isin("superseded", "deprecated", "rejected"), F.struct(F.lit("superseded").alias("o"), F.lit(1.0).alias("c"))).when(~F.col("binding"), F.struct(F.lit("non-binding").alias("o"), F.lit(1.0).alias("c")))
    case = case.when(F.coalesce("n", F.lit(0)) == 0, F.struct(F.lit("unverifiable").alias("o"), F.lit(1.0).alias("c"))).when(F.col("violations") == 0, F.struct(F.lit("conformant").alias("o"), F.lit(0.9).alias("c"))).otherwise(F.struct(F.lit("probable-drift").alias("o"), F.lit(0.93).alias("c")))
    return rows.withColumn("x", case).select("decision", "number", F.col("x.o").alias("outcome"), F.col("x.c").alias("confidence"), "violations")


def audit_report(outcomes: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audited decisions in order, counts with notes): numbered decisions first by number, then by path. paths: decision, path.

    The order is a rank over ranges of rows.
    """
    rows = ranked(outcomes.join(paths, "decision", "left"), [], [F.col("number").isNull().asc(), F.asc("number"), F.asc("path")], "place")
    n = outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
    count = F.col("n").cast("string")
    note = F.when(F.col("outcome") == "probable-drift", F.concat(count, F.lit(" decision(s) show probable drift from the code"))).when(F.col("outcome") == "unverifiable", F.concat(count, F.lit(" decision(s) could not be checked: there was no evidence in the graph to check them against")))
    return rows, n.withColumn("note", note)


def layer_names(id_: Column) -> Column:
    """What may be a layer in an id: each text between a space and a later slash, and each text behind a slash up to the end."""
    pieces = lambda text, sep, low, high, first: F.when(high >= low, F.transform(F.sequence(low, high), lambda i: F.array_join(F.slice(F.split(text, sep), F.lit(1) if first else i, i if first else F.size(F.split(text, sep))), sep))).otherwise(F.array().cast("array<string>"))
    count = lambda text, sep: F.size(F.split(text, sep))
    ends = pieces(id_, "/", F.lit(2), count(id_, "/"), False)
    tails = pieces(id_, " ", F.lit(2), count(id_, " "), False)
    inner = F.flatten(F.transform(tails, lambda t: pieces(t, "/", F.lit(1), count(t, "/") - 1, True)))
    return F.array_distinct(F.concat(inner, ends))


def target_layer(edges: DataFrame, nodes: DataFrame, layers: DataFrame, rule: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(decision, source, target, layer): the layer of a target's path, else the first layer of the rule that stands in its id between a
    space and a slash, or behind a slash at the end. edges: source, target, each pair once.

    Layers are found for each target, so the edges are shuffled once. ``targets`` are what edges may lead to, where that is known
    without a pass over them.
    """
    by_path = nodes.select(*G, F.col("id").alias("target"), "path").join(layers.select(*G, "decision", "path", "layer"), [*G, "path"]).select(*G, "decision", "target", "layer")
    targets = (edges if targets is None else targets).select(*G, "target").distinct().withColumn("layer", F.explode(layer_names(F.col("target"))))
    named = targets.join(rule.select("decision", "layer", "rank").distinct(), "layer").groupBy(*G, "decision", "target").agg(F.min_by("layer", "rank").alias("layer"))
    found = by_path.unionByName(named.join(by_path, [*G, "decision", "target"], "left_anti"))
    return edges.select(*G, "source", "target").join(found, [*G, "target"]).select(*G, "decision", "source", "target", "layer")
