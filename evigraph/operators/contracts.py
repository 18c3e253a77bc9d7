"""Contract checks that give violation rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import G

#: Evidence kinds that were measured by a tool (fixed values).
DETERMINISTIC = ("compiler", "language-server", "build-system", "schema", "static-analysis", "test")


def duplicate_ids(rows: DataFrame) -> DataFrame:
    """A row for each id that occurs n times, with the n - 1 violations it makes."""
    return rows.groupBy(*G, "id").agg((F.count("*") - 1).alias("violations")).where("violations > 0")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = [edges.select(*G, "id", F.lit(e).alias("end"), F.col(e).alias("node")) for e in ("source", "target")]
    return ends[0].unionByName(ends[1]).join(nodes.select(*G, F.col("id").alias("node")), [*G, "node"], "left_anti").select(*G, "id", "end", "node")


def bad_line_order(nodes: DataFrame) -> DataFrame:
    return nodes.where("start_line > end_line").select(*G, "id", "start_line", "end_line")


def unknown_paths(nodes: DataFrame, files: DataFrame | None) -> DataFrame:
    """Paths that the file table lacks; nothing is said without a table."""
    placed = nodes.where("path is not null").select(*G, "id", "path")
    return placed.limit(0) if files is None else placed.join(files.select(*G, "path"), [*G, "path"], "left_anti").select(*G, "id", "path")


def unmeasured_edges(edges: DataFrame, kinds: tuple[str, ...] = DETERMINISTIC) -> DataFrame:
    measured = F.exists("evidence", lambda e: e["kind"].isin(*kinds))
    return edges.where(~F.coalesce(measured, F.lit(False))).select(*G, "id")


def check_contract(rows: DataFrame, rules: dict[str, str], key: list[str]) -> DataFrame:
    """(key, rule) for each row that breaks a rule, given as a SQL condition; an unknown condition isn't broken."""
    broken = F.array_compact(F.array(*(F.when(~F.expr(c), name) for name, c in rules.items())))
    return rows.select(*key, F.explode(broken).alias("rule"))


CYCLE_SHARE, ORPHAN_SHARE, IMPACT_SHARE = 0.3, 0.5, 0.5


def graph_health(modules: DataFrame, comps: DataFrame, levels: DataFrame, fans: DataFrame, entries: DataFrame, start: DataFrame) -> DataFrame:
    """(check, value, most, passed): the whole-graph sanity rules of one snapshot each. start: the modules to start with."""
    n = modules.groupBy(*G).agg(F.count("*").alias("n"))
    size = comps.groupBy(*G, "component").count().groupBy(*G).agg(F.max(F.when(F.col("count") > 1, F.col("count")).otherwise(0)).alias("x"))
    depth = levels.groupBy(*G).agg(F.count_distinct("level").alias("x"))
    lone = fans.groupBy(*G).agg(F.count(F.when((F.col("fan_in") == 0) & (F.col("fan_out") == 0), 1)).alias("x"))
    some = lambda rows: rows.groupBy(*G).agg(F.count("*").alias("x"))
    share, count, none, x = F.col("x") / F.col("n"), F.col("x").cast("double"), F.lit(None).cast("double"), F.col("x")
    checks = (
        ("largest cycle", size, share, F.lit(CYCLE_SHARE), x <= F.col("n") * CYCLE_SHARE),
        ("levels", depth, count, none, (x > 1) | (F.col("n") < 5)),
        ("orphans", lone, share, F.lit(ORPHAN_SHARE), x < F.col("n") * ORPHAN_SHARE),
        ("entry points", some(entries), count, none, x > 0),
        ("start here", some(start), count, none, x > 0),
    )
    out = [n.join(rows, list(G), "left").na.fill(0, ["x"]).select(*G, F.lit(name).alias("check"), value.alias("value"), most.alias("most"), passed.alias("passed")) for name, rows, value, most, passed in checks]
    return reduce(DataFrame.unionByName, out)


def change_health(nodes: DataFrame, impact: DataFrame, raw: DataFrame, bumps: DataFrame, skipped: DataFrame) -> DataFrame:
    """(check, value, most, passed): the sanity rules of one change each.

    nodes: repository_id of each head node; impact: a row for each symbol reached; raw: n identities with a version left in them; bumps:
    package, bump, reason; skipped: package.
    """
    key = "repository_id"
    n = nodes.groupBy(key).agg(F.count("*").alias("n"))
    each = n.join(impact.groupBy(key).agg(F.count("*").alias("reached")), key, "left").join(raw.select(key, F.col("n").alias("raw")), key, "left")
    unknown = F.col("bump") == "unknown"
    said = bumps.groupBy(key).agg(F.count("*").alias("measured"), F.count(F.when(unknown, 1)).alias("unknown"), F.count(F.when(unknown & F.col("reason").isNull(), 1)).alias("unexplained"))
    each = each.join(said, key, "left").join(skipped.groupBy(key).agg(F.count("*").alias("skipped")), key, "left").na.fill(0)
    none = F.lit(None).cast("double")
    row = lambda name, value, most, passed: F.struct(F.lit(name).alias("check"), value.cast("double").alias("value"), most.alias("most"), passed.alias("passed"))
    checks = F.array(
        row("impact", F.col("reached") / F.col("n"), F.lit(IMPACT_SHARE), F.col("reached") <= F.col("n") * IMPACT_SHARE),
        row("raw identities", F.col("raw"), F.lit(0.0), F.col("raw") == 0),
        row("unknown bumps", F.col("unknown"), F.lit(0.0), F.col("unknown") == 0),
        row("unexplained bumps", F.col("unexplained"), F.lit(0.0), F.col("unexplained") == 0),
        row("packages measured or explained", F.col("measured") + F.col("skipped"), none, F.col("measured") + F.col("skipped") > 0),
    )
    return each.select(key, F.explode(checks).alias("c")).select(key, "c.*")
