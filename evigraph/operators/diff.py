"""Structural differences of two snapshots, API surfaces and labels of a change.

A side is nodes or edges of one snapshot; ``change`` keys the pair. Absent measurements stay null.
"""

from __future__ import annotations

import difflib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.identity import is_normalized, stable_key, version_of
from .common import cut, dominant_pairs, interval_join

R = "repository_id"
RENAME_FLOOR, SPAN_FLOOR = 0.6, 0.75


def keyed_nodes(nodes: DataFrame) -> DataFrame:
    """One node for each stable key, the highest id on a collision, and how many ids met."""
    rest = [c for c in nodes.columns if c not in (R, "id", "revision")]
    keyed = nodes.withColumn("key", stable_key(F.col("id")))
    best = keyed.groupBy(R, "key").agg(F.max_by(F.struct("id", *rest), "id").alias("n"), F.count_distinct("id").alias("ids"))
    return best.select(R, "key", "n.*", "ids")


def keyed_edges(edges: DataFrame) -> DataFrame:
    """One edge for each stable source, kind, target and configuration."""
    k = edges.select(R, stable_key(F.col("source")).alias("source"), "kind", stable_key(F.col("target")).alias("target"), F.coalesce("configuration", F.lit("")).alias("configuration"))
    return k.distinct()


def node_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """(key, change): added, removed or common, from keyed nodes."""
    b, h = base.select(R, "key", F.lit(1).alias("b")), head.select(R, "key", F.lit(1).alias("h"))
    return b.join(h, [R, "key"], "full").select(R, "key", F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").otherwise("common").alias("change"))


def moved_nodes(base: DataFrame, head: DataFrame) -> DataFrame:
    b = base.select(R, "key", F.col("path").alias("before"))
    return b.join(head.select(R, "key", "label", F.col("path").alias("after")), [R, "key"]).where("before != after").select(R, "key", "label", "before", "after")


def touched_nodes(head: DataFrame, added_lines: DataFrame) -> DataFrame:
    """Head nodes whose closed span holds an added line (repository_id, path, line)."""
    spans = head.select(R, "key", "path", F.col("start_line").alias("l_start"), F.col("end_line").alias("l_end"))
    lines = added_lines.select(R, "path", F.col("line").alias("r_start"), F.col("line").alias("r_end"))
    return interval_join(spans, lines, [R, "path"]).select(R, "key").distinct()


def edge_delta(base: DataFrame, head: DataFrame, base_nodes: DataFrame, head_nodes: DataFrame) -> DataFrame:
    """Edges added or removed with the labels of their ends, their keys where a node is missing."""
    key = ["source", "kind", "target", "configuration"]
    both = base.withColumn("b", F.lit(1)).join(head.withColumn("h", F.lit(1)), [R, *key], "full").where("b is null or h is null")
    both = both.select(R, *key, F.when(F.col("b").isNull(), "added").otherwise("removed").alias("change"))
    labels = head_nodes.select(R, "key", F.lit("added").alias("change"), "label").unionByName(base_nodes.select(R, "key", F.lit("removed").alias("change"), "label"))
    for end in ("source", "target"):
        both = both.join(labels.withColumnsRenamed({"key": end, "label": f"{end}_label"}), [R, "change", end], "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", end))
    return both


def version_changes(base: DataFrame, head: DataFrame) -> DataFrame:
    b, h = (n.where("kind = 'package'").select(R, "key", "label", version_of(F.col("id")).alias(v)) for n, v in ((base, "before"), (head, "after")))
    return b.drop("label").join(h, [R, "key"]).where("before != after").select(R, F.col("label").alias("name"), "before", "after")


def similar_labels(removed: DataFrame, added: DataFrame, by: list[str], floor: float) -> DataFrame:
    """Pairs of equal ``by`` whose labels may have a similarity of ``floor`` or more: removed as ``a``, added as ``b``.

    Similarity is twice the matching characters by all characters. So labels of m and n characters share at least (m + n) * floor / 2,
    each counted as often as both have it, and one of them has no less than floor / (2 - floor) times the other's length. Of a label's
    characters, numbered among their equals and ordered by that number downwards, at least one of the first few is then shared: a join
    on these, in which a pair is kept at the first that it shares, finds every such pair once, without listing all pairs.
    """
    share = floor / (2 - floor)
    size = F.length("label")

    def cut_labels(side: DataFrame, name: str) -> DataFrame:
        chars = F.array_sort(F.split("label", ""))
        tokens = F.array_sort(F.transform(chars, lambda c, i: F.struct((F.array_position(chars, c) - 1 - i).alias("nth"), c.alias("c"))))
        first = F.when(size == 0, F.array(F.struct(F.lit(0).cast("long").alias("nth"), F.lit("").alias("c")))).otherwise(F.slice(tokens, 1, size - F.ceil(size * share - 1e-9).cast("int") + 1))
        cut_side = side.withColumn("label", F.coalesce("label", F.lit(""))).withColumns({"first": first})
        return cut_side.select(*by, F.struct(*(c for c in cut_side.columns if c not in by), size.alias("size")).alias(name), F.explode("first").alias("token"))

    pairs = cut_labels(removed, "a").join(cut_labels(added, "b"), [*by, "token"])
    pairs = pairs.where(2 * F.least("a.size", "b.size") >= floor * (F.col("a.size") + F.col("b.size")) - 1e-9)
    return pairs.where(F.array_min(F.array_intersect("a.first", "b.first")) == F.col("token")).drop("token")


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series, floor: pd.Series) -> pd.Series:
    """How similar labels are; below ``floor`` only that they are below it."""

    def ratio(x: str, y: str, least: float) -> float:
        m = difflib.SequenceMatcher(None, x, y)
        # the quick figures are upper bounds
        return m.ratio() if m.real_quick_ratio() >= least and m.quick_ratio() >= least else 0.0

    return pd.Series([ratio(x, y, least) for x, y, least in zip(a, b, floor)], dtype="float64")


def rename_guesses(removed: DataFrame, added: DataFrame) -> DataFrame:
    """One-to-one guesses (repository_id, old, new, confidence, basis) among removed and added symbols of one kind in one file.

    Overlapping spans give at least 0.75, else the labels' similarity must reach 0.6; better ones go first, ties by key. A null label is
    an empty one; symbols without a path take no part; a span without a start overlaps nothing.
    """
    block = [R, "kind", "path"]
    sides = [cut(s.where("path is not null").select(*block, "key", F.coalesce("label", F.lit("")).alias("label"), "start_line", "end_line")) for s in (removed, added)]
    spans = [s.select(*block, F.struct("key", "label").alias(n), F.col("start_line").alias(f"{x}_start"), F.col("end_line").alias(f"{x}_end")) for s, n, x in zip(sides, "ab", "lr")]
    near = interval_join(spans[0], spans[1], block).select(*block, "a", "b", F.lit(True).alias("overlap"))
    end = lambda x: F.coalesce(f"{x}.end_line", f"{x}.start_line")
    apart = ~F.coalesce((F.col("a.start_line") <= end("b")) & (F.col("b.start_line") <= end("a")), F.lit(False))
    alike = similar_labels(*sides, block, RENAME_FLOOR).where(apart)
    alike = alike.select(*block, *(F.struct(f"{n}.key", f"{n}.label").alias(n) for n in "ab"), F.lit(False).alias("overlap"))
    pairs = near.unionByName(alike).withColumn("same", similarity(F.col("a.label"), F.col("b.label"), F.when(F.col("overlap"), 0.0).otherwise(RENAME_FLOOR)))
    pairs = pairs.where(F.col("overlap") | (F.col("same") >= RENAME_FLOOR))
    pairs = pairs.select(*block, F.col("a.key").alias("old"), F.col("b.key").alias("new"), F.when(F.col("overlap"), F.greatest("same", F.lit(SPAN_FLOOR))).otherwise(F.col("same")).alias("weight"), "same", "overlap")
    basis = F.concat(F.when(F.col("overlap"), "same file and overlapping source range; name similarity ").otherwise("same file; name similarity "), F.format_string("%.2f", "same"))
    return dominant_pairs(pairs, block).select(R, "old", "new", F.round("weight", 3).alias("confidence"), basis.alias("basis"))


def unnormalized_count(base: DataFrame, head: DataFrame) -> DataFrame:
    both = base.select(R, "key", F.lit(0).alias("side"), "id").unionByName(head.select(R, "key", F.lit(1).alias("side"), "id"))
    chosen = both.groupBy(R, "key").agg(F.max_by("id", "side").alias("id"))
    return chosen.groupBy(R).agg(F.count(F.when(~is_normalized(F.col("id")), 1)).alias("n"))


def diff_summary(nodes: DataFrame, edges: DataFrame, moved: DataFrame) -> DataFrame:
    """Counts of one change: nodes and edges added and removed, nodes moved."""
    count = lambda c: F.count(F.when(F.col("change") == c, 1))
    n = nodes.groupBy(R).agg(count("added").alias("nodes_added"), count("removed").alias("nodes_removed"))
    e = edges.groupBy(R).agg(count("added").alias("edges_added"), count("removed").alias("edges_removed"))
    m = moved.groupBy(R).agg(F.count("*").alias("nodes_moved"))
    zero = ("nodes_added", "nodes_removed", "edges_added", "edges_removed", "nodes_moved")
    return n.join(e, R, "full").join(m, R, "full").select(R, *(F.coalesce(c, F.lit(0)).alias(c) for c in zero))


# Paths and kinds that mark tests and documentation.
TEST_PATH = r"(^|/)(tests?|benches|testdata|fixtures)/"
TEST_FILE = r"(^|/)(test_[^/]+|[^/]+_test)\.[a-z]+$"
TEST_KINDS = ("test", "test-module")
DOC_SUFFIX = r"\.(md|rst|txt|adoc)$"
DOC_PATH = r"(^|/)(docs?|adr)/"


def change_labels(nodes: DataFrame, moved: DataFrame, renames: DataFrame | None = None, api_names: DataFrame | None = None) -> DataFrame:
    """(name, basis): the labels that a change earns, each with the first thing that shows it.

    nodes: kind and path of the added, removed and touched nodes; moved: label, before, after; renames: before_label, after_label, new,
    basis, confidence; api_names: name of each changed item of the API delta. Without an API delta nothing is said of interfaces; a
    delta that names nothing makes a change internal.
    """

    def label(rows: DataFrame, name: str, basis: Column) -> DataFrame:
        return rows.groupBy(R).agg(basis.alias("basis")).select(R, F.lit(name).alias("name"), "basis")

    def counted(what: str, column: str) -> Column:
        return F.concat(F.count("*").cast("string"), F.lit(f" {what}, including "), F.min(column))

    path = F.col("path")
    placed = nodes.where("path is not null")
    out = [
        label(moved, "code-move", F.min_by(F.concat("label", F.lit(" moved from "), "before", F.lit(" to "), "after"), F.struct("after", "before", "label"))),
        label(placed.where(path.rlike(TEST_PATH) | path.rlike(TEST_FILE) | F.col("kind").isin(*TEST_KINDS)), "testing", counted("test path(s) changed", "path")),
        label(placed.where(path.rlike(DOC_SUFFIX) | path.rlike(DOC_PATH)), "documentation", counted("documentation path(s) changed", "path")),
    ]
    if renames is not None:
        line = F.concat("before_label", F.lit(" appears to have become "), "after_label", F.lit(" ("), "basis", F.lit(", confidence "), F.format_string("%.2f", "confidence"), F.lit(")"))
        out.append(label(renames.withColumn("_line", line), "rename", F.min_by("_line", F.struct("new", "_line"))))
    if api_names is not None:
        names = api_names.select(R, "name").distinct()
        out.append(label(names, "external-interface", counted("exported item(s) changed in the public API delta", "name")))
        inside = F.concat(F.count("*").cast("string"), F.lit(" symbol(s) changed and none appear in the public API delta"))
        out.append(label(nodes.join(names.select(R).distinct(), R, "left_anti"), "internal-interface", inside))
    return reduce(DataFrame.unionByName, out)


# --- API surfaces: items (repository_id, package, item), skipped (repository_id, package, reason) ------------------------------


def surface_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """(package, item, change) of the packages measured on both sides."""
    shared = base.select(R, "package").distinct().join(head.select(R, "package").distinct(), [R, "package"])
    b, h = (s.join(shared, [R, "package"], "left_semi").select(R, "package", "item", F.lit(1).alias(n)).distinct() for s, n in ((base, "b"), (head, "h")))
    return b.join(h, [R, "package", "item"], "full").select(R, "package", "item", F.when(F.col("b").isNull(), "added").when(F.col("h").isNull(), "removed").otherwise("unchanged").alias("change"))


def surface_counts(delta: DataFrame) -> DataFrame:
    return delta.groupBy(R, "package").agg(*(F.count(F.when(F.col("change") == c, 1)).alias(c) for c in ("added", "removed", "unchanged")))


def required_bump(counts: DataFrame, lints: DataFrame, analyzed: DataFrame) -> DataFrame:
    """(package, bump): unknown unless analyzed; removals and major lints are major, additions and minor lints minor."""
    worst = lints.groupBy(R, "package").agg(F.bool_or(F.col("level") == "major").alias("major"), F.bool_or(F.col("level") == "minor").alias("minor"))
    rows = counts.join(worst, [R, "package"], "left").join(analyzed.select(R, "package").distinct().withColumn("known", F.lit(True)), [R, "package"], "left")
    bump = F.when(F.col("known").isNull(), "unknown").when(F.coalesce("major", F.lit(False)) | (F.col("removed") > 0), "major").when(F.coalesce("minor", F.lit(False)) | (F.col("added") > 0), "minor").otherwise("none")
    return rows.select(R, "package", bump.alias("bump"))


def bump_reason(bumps: DataFrame, reasons: DataFrame) -> DataFrame:
    """Why a bump is unknown; null for known ones."""
    return bumps.join(reasons, [R, "package"], "left").select(R, "package", "bump", F.when(F.col("bump") == "unknown", F.coalesce("reason", F.lit("not analyzed"))).alias("reason"))


def skipped_packages(skip_base: DataFrame, skip_head: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """Reasons of both sides and of packages found on one only, distinct and sorted."""
    b, h = base.select(R, "package").distinct(), head.select(R, "package").distinct()
    rows = skip_base.select(R, "package", "reason").unionByName(skip_head.select(R, "package", "reason"))
    rows = rows.unionByName(b.join(h, [R, "package"], "left_anti").withColumn("reason", F.lit("absent at head"))).unionByName(h.join(b, [R, "package"], "left_anti").withColumn("reason", F.lit("absent at base")))
    return rows.groupBy(R, "package").agg(F.concat_ws("; ", F.array_sort(F.collect_set("reason"))).alias("reason"))


def breaking(bumps: DataFrame) -> DataFrame:
    return bumps.groupBy(R).agg(F.bool_or(F.col("bump") == "major").alias("breaking"))


def item_symbol(item: Column) -> Column:
    """The name in an item: the last word before its parameters, with its path; null for a blank item."""
    words = F.filter(F.split(F.split(item, r"\(")[0], r"\s+"), lambda w: w != "")
    return F.try_element_at(words, F.lit(-1))


# Fixed value: an exported item and its dotted path.
API_ITEM = r"^pub (?:\w+ )*?([A-Za-z_][A-Za-z0-9_]*(?:::[A-Za-z0-9_]+)+)"


def exported_paths(items: DataFrame) -> DataFrame:
    return items.select(R, F.replace(F.regexp_extract("item", API_ITEM, 1), F.lit("::"), F.lit("/")).alias("path")).where("path != ''").distinct()


def items_for_definitions(delta: DataFrame, nodes: DataFrame) -> DataFrame:
    """Items that name a definition of a file as a whole identifier: equi-join on words, a search in the text for other labels."""
    defs = nodes.where("kind in ('function', 'type', 'constant')").select(R, "path", "label")
    words = delta.where("change != 'unchanged'").withColumn("label", F.explode(F.array_distinct(F.regexp_extract_all("item", F.lit(r"([A-Za-z0-9_]+)")))))
    plain = words.join(defs.where(F.col("label").rlike("^[A-Za-z0-9_]+$")), [R, "label"])
    # labels that aren't one word: found by their longest word, then searched for in the text
    long = F.array_max(F.transform(F.regexp_extract_all("label", F.lit(r"([A-Za-z0-9_]+)")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    others = defs.where(~F.col("label").rlike("^[A-Za-z0-9_]+$")).withColumn("word", long)
    odd = words.withColumnRenamed("label", "word").join(others.where("word is not null"), [R, "word"]).where(F.instr(F.col("item"), F.col("label")) > 0)
    return plain.select(R, "path", "item", "change").unionByName(odd.select(R, "path", "item", "change")).distinct()
