"""Rollups, matrices and readability of views over a snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import G, components, cut, ranked
from .overview import layered

MOST_NODES, MOST_DENSITY, MOST_DEGREE = 25, 3.0, 10


def package_edges(weights: DataFrame, owners: DataFrame) -> DataFrame:
    """Weights summed over module edges between different packages."""
    a, b = (owners.select(*G, F.col("path").alias(e), F.col("package").alias(p)) for e, p in (("src", "a"), ("dst", "b")))
    rows = weights.join(a, [*G, "src"]).join(b, [*G, "dst"]).where("a != b")
    return rows.groupBy(*G, F.col("a").alias("source"), F.col("b").alias("target")).agg(F.sum("weight").alias("weight"))


def package_view(weights: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with fans and level, edges) of packages."""
    edges = package_edges(weights, owners)
    nodes = owners.where("package is not null").select(*G, F.col("package").alias("path")).distinct()
    deps = edges.select(*G, F.col("source").alias("src"), F.col("target").alias("dst"))
    levels = layered(deps, nodes)
    out = edges.groupBy(*G, F.col("source").alias("path")).agg(F.count("*").alias("fan_out"))
    into = edges.groupBy(*G, F.col("target").alias("path")).agg(F.count("*").alias("fan_in"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("fan_in", "fan_out")]
    return levels.join(into, [*G, "path"], "left").join(out, [*G, "path"], "left").select(*G, F.col("path").alias("package"), "level", *zero), edges


def levelized_edges(weights: DataFrame, owners: DataFrame, comps: DataFrame, same_component: bool = False) -> DataFrame:
    """(package, src, dst, weight, drawn): edges inside a package; drawn if both ends are in some cycle (or in the same one)."""
    a, b = (owners.select(*G, F.col("path").alias(e), F.col("package").alias(p)) for e, p in (("src", "a"), ("dst", "b")))
    size = comps.withColumn("size", F.count("*").over(Window.partitionBy(*G, "component")))
    c, d = (size.select(*G, F.col("path").alias(e), F.col("component").alias(n), (F.col("size") > 1).alias(f"in_{n}")) for e, n in (("src", "c"), ("dst", "d")))
    rows = weights.join(a, [*G, "src"]).join(b, [*G, "dst"]).where("a = b").join(c, [*G, "src"]).join(d, [*G, "dst"])
    drawn = F.col("in_c") & F.col("in_d")
    return rows.select(*G, F.col("a").alias("package"), "src", "dst", "weight", ((drawn & (F.col("c") == F.col("d"))) if same_component else drawn).alias("drawn"))


def levelized_nodes(levels: DataFrame, owners: DataFrame) -> DataFrame:
    """(package, path, level) of the modules of each package's view."""
    return levels.join(owners, [*G, "path"]).where("package is not null").select(*G, "package", "path", "level")


def suppressed_edges(levelized: DataFrame) -> DataFrame:
    return levelized.groupBy(*G, "package").agg(F.count(F.when(F.col("drawn"), 1)).alias("drawn"), F.count(F.when(~F.col("drawn"), 1)).alias("suppressed"))


def matrix_cells(weights: DataFrame, levels: DataFrame) -> DataFrame:
    """(row, col, weight): modules are numbered by level and path; a cell over the diagonal may be part of a cycle."""
    index = cut(ranked(levels.select(*G, "path", "level"), list(G), [F.asc("level"), F.asc("path")], "i").select(*G, "path", (F.col("i") - 1).alias("i")))
    rows = weights.join(index.withColumnsRenamed({"path": "src", "i": "row"}), [*G, "src"]).join(index.withColumnsRenamed({"path": "dst", "i": "col"}), [*G, "dst"])
    return rows.select(*G, "row", "col", "weight")


def readability(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(view, nodes, edges, density, degree, readable): checks on unrounded values. nodes (view, node), edges (view, source, target)."""
    n = nodes.groupBy(*G, "view").agg(F.count("*").alias("nodes"))
    e = edges.groupBy(*G, "view").agg(F.count("*").alias("edges"))
    ends = edges.select(*G, "view", F.col("source").alias("node")).unionAll(edges.select(*G, "view", F.col("target").alias("node")))
    degree = ends.groupBy(*G, "view", "node").agg(F.count("*").alias("d")).groupBy(*G, "view").agg(F.max("d").alias("degree"))
    rows = n.join(e, [*G, "view"], "left").join(degree, [*G, "view"], "left").select(*G, "view", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("degree", F.lit(0)).alias("degree"))
    rows = rows.withColumn("density", F.col("edges") / F.col("nodes"))
    return rows.withColumn("readable", (F.col("nodes") <= MOST_NODES) & (F.col("density") <= MOST_DENSITY) & (F.col("degree") <= MOST_DEGREE))


def gate_views(checks: DataFrame) -> DataFrame:
    """(view, accepted, reason): the first check that fails; a matrix is always accepted."""
    reason = F.when(F.col("view").startswith("matrix"), None).when(F.col("nodes") > MOST_NODES, "too many nodes").when(F.col("density") > MOST_DENSITY, "too dense").when(F.col("degree") > MOST_DEGREE, "too many edges at one node")
    return checks.select(*G, "view", reason.isNull().alias("accepted"), reason.alias("reason"))


def container_key(name: Column) -> Column:
    """Letters, digits and inner underscores; ``c_`` before a digit or nothing."""
    clean = F.trim(F.regexp_replace(name, "[^0-9A-Za-z_]", "_"), F.lit("_"))
    return F.when(clean.rlike("^([0-9]|$)"), F.concat(F.lit("c_"), clean)).otherwise(clean)


def containers(packages: DataFrame, depends: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(containers, relationships): packages (id, name, version) with clean keys, the version kept where names meet; between two keys the
    first edge by its id. depends: id, source, target, kind."""
    many = F.count("*").over(Window.partitionBy(*G, "name")) > 1
    boxes = packages.select(*G, "id", "name", container_key(F.when(many, F.concat_ws("_", "name", "version")).otherwise(F.col("name"))).alias("key"))
    ends = [boxes.select(*G, F.col("id").alias(e), F.col("key").alias(f"{e}_key")) for e in ("source", "target")]
    links = depends.join(ends[0], [*G, "source"]).join(ends[1], [*G, "target"]).where("source_key != target_key")
    first = links.groupBy(*G, "source_key", "target_key").agg(F.min_by(F.struct("kind", "id"), "id").alias("e"))
    return boxes, first.select(*G, "source_key", "target_key", "e.kind", F.col("e.id").alias("evidence"))


def in_repo_architecture(boxes: DataFrame, relationships: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(containers, relationships, checks) of each snapshot's own packages (name).

    containers: key, name, level, fan_in, fan_out, over the relationships that have both ends among them. checks: containers,
    relationships, dropped (packages that aren't drawn), and by ``readability`` the density, largest degree and whether it can be read.
    """
    mine = cut(boxes.join(own.select(*G, "name").distinct(), [*G, "name"], "left_semi"))
    keys, kept = mine.select(*G, "key").distinct(), relationships
    for e in ("source_key", "target_key"):
        kept = kept.join(keys.withColumnRenamed("key", e), [*G, e], "left_semi")
    kept = cut(kept)
    levels = layered(kept.select(*G, F.col("source_key").alias("src"), F.col("target_key").alias("dst")), keys.withColumnRenamed("key", "path"))
    rows = mine.join(levels.select(*G, F.col("path").alias("key"), "level"), [*G, "key"])
    for e, fan in (("target_key", "fan_in"), ("source_key", "fan_out")):
        rows = rows.join(kept.groupBy(*G, F.col(e).alias("key")).agg(F.count("*").alias(fan)), [*G, "key"], "left").withColumn(fan, F.coalesce(fan, F.lit(0)))
    view = F.lit("architecture").alias("view")
    checks = readability(mine.select(*G, view, F.col("key").alias("node")), kept.select(*G, view, F.col("source_key").alias("source"), F.col("target_key").alias("target")))
    dropped = boxes.groupBy(*G).agg(F.count("*").alias("all"))
    checks = dropped.join(checks.drop("view"), list(G), "left").withColumn("nodes", F.coalesce("nodes", F.lit(0)))
    checks = checks.select(*G, F.col("nodes").alias("containers"), F.coalesce("edges", F.lit(0)).alias("relationships"), (F.col("all") - F.col("nodes")).alias("dropped"), F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("readable", F.lit(True)).alias("readable"))
    return rows.select(*G, "key", "name", "level", "fan_in", "fan_out"), kept, checks


def level_groups(levels: DataFrame, drawn: DataFrame) -> DataFrame:
    """(path, level, component): connected groups within a level over the drawn edges (src, dst)."""
    a, b = (levels.select(*G, F.col("path").alias(e), F.col("level").alias(n)) for e, n in (("src", "a"), ("dst", "b")))
    inside = drawn.join(a, [*G, "src"]).join(b, [*G, "dst"]).where("a = b").select(*G, F.col("a").alias("level"), F.col("src").alias("source"), F.col("dst").alias("target"))
    return components(inside, levels.select(*G, "level", F.col("path").alias("node")), [*G, "level"])


def short_names(labels: DataFrame) -> DataFrame:
    """(view, label, short): the shortest end of a path-like label that no other label of the view has."""
    parts = F.split("label", "/")
    ends = labels.select(*G, "view", "label").distinct().withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("short", F.array_join(F.slice(parts, -F.col("depth"), F.col("depth")), "/"))
    ends = ends.withColumn("n", F.count("*").over(Window.partitionBy(*G, "view", "short")))
    # a label that is the end of another has no end of its own and keeps its full text
    best = ends.groupBy(*G, "view", "label").agg(F.coalesce(F.min_by(F.when(F.col("n") == 1, F.col("short")), F.when(F.col("n") == 1, F.col("depth"))), F.col("label")).alias("short"))
    return best
