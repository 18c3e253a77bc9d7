"""Usages, search and path queries over a snapshot."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import G, cut, ranked, top

USAGE_KINDS = ("calls", "reads", "imports", "implements", "extends")
#: Which kind speaks for a pair (fixed order).
PRECEDENCE = ("calls", "implements", "extends", "reads", "imports")
NEIGHBOURS, MOST_STEPS, LEAST_MODULES = 24, 14, 3


def usages(edges: DataFrame) -> DataFrame:
    """Distinct (source, target) over the usage kinds."""
    return edges.where(F.col("kind").isin(*USAGE_KINDS)).select(*G, "source", "target").distinct()


def usage_counts(uses: DataFrame) -> DataFrame:
    """(symbol, uses, used_by)."""
    rows = uses.select(*G, F.col("source").alias("symbol"), F.lit(1).alias("out")).unionAll(uses.select(*G, F.col("target").alias("symbol"), F.lit(0).alias("out")))
    return rows.groupBy(*G, "symbol").agg(F.sum("out").alias("uses"), F.sum(1 - F.col("out")).alias("used_by"))


def pair_kind(edges: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, PRECEDENCE)), F.col("kind"))
    return edges.where(F.col("kind").isin(*USAGE_KINDS)).groupBy(*G, "source", "target").agg(F.min_by("kind", rank).alias("kind"))


def elements(rows: DataFrame) -> DataFrame:
    """Projected nodes or edges: their own columns, distinct sorted producers, the largest confidence (unknown ones count as 1)."""
    producers = F.array_sort(F.array_distinct(F.transform("evidence", lambda e: e["producer"])))
    confidence = F.array_max(F.transform("evidence", lambda e: F.coalesce(F.nullif(e["confidence"], F.lit(0.0)), F.lit(1.0))))
    own = [c for c in ("id", "kind", "label", "source", "target", "configuration", "language", "path", "start_line", "end_line", "public") if c in rows.columns]
    return rows.select(*G, *own, F.array_join(producers, ",").alias("producers"), confidence.alias("confidence"))


def definitions_in_range(defs: DataFrame, requests: DataFrame) -> DataFrame:
    """Definitions that start within each request (request_id, path, from_line, to_line), by start."""
    rows = requests.join(defs, [*G, "path"]).where("start_line between from_line and to_line")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("request_id").orderBy("start_line", "id"))).select("request_id", "n", "id", "start_line")


def module_links(nodes: DataFrame, uses: DataFrame) -> DataFrame:
    """(path, other, symbols): symbols of another file that a file uses; uses that have the paths of their ends (src, dst) are not joined."""
    if not {"src", "dst"} <= set(uses.columns):
        place = nodes.where("kind != 'file' and path is not null").select(*G, "id", "path")
        uses = uses.join(place.withColumnsRenamed({"id": "source", "path": "src"}), [*G, "source"]).join(place.withColumnsRenamed({"id": "target", "path": "dst"}), [*G, "target"])
    return uses.where("src != dst").groupBy(*G, F.col("src").alias("path"), F.col("dst").alias("other")).agg(F.count_distinct("target").alias("symbols"))


def predecessors(starts: DataFrame, uses: DataFrame, goals: DataFrame | None = None, rounds: int = 100_000) -> DataFrame:
    """(start, node, hop, parent): how a breadth-first search from each start first comes to each node, users before used, smaller ids first.

    There is one row for each start and node, whatever the number of goals. A round follows the edges of the nodes met in the one before;
    these are numbered in the order in which the search meets them, so a node's parent is the first that leads to it. A start with
    ``goals`` (start, node) is done once it has met them all; the rounds end when no start has a node left to visit.
    """
    key = [*G, "start"]
    front = cut(starts.select(*key).distinct().select(*key, F.col("start").alias("node"), F.lit(1).cast("long").alias("place")))
    met = found = front.select(*key, "node", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("parent"))
    steps = uses.select(*G, F.col("source").alias("node"), F.col("target").alias("next")).distinct()
    for hop in range(1, rounds):
        if goals is not None:
            goals = cut(goals.select(*key, "node").join(front, [*key, "node"], "left_anti"))
            front = front.join(goals.select(*key).distinct(), key, "left_semi")
        step = front.join(steps, [*G, "node"]).groupBy(*key, F.col("next")).agg(F.min(F.struct("place", F.col("node").alias("parent"))).alias("by"))
        step = step.withColumnRenamed("next", "node").join(met.select(*key, "node"), [*key, "node"], "left_anti")
        front = cut(ranked(step.select(*key, "node", "by.parent", F.col("by.place").alias("after")), key, [F.asc("after"), F.asc("node")], "place"))
        if not front.take(1):
            return found
        new = front.select(*key, "node", F.lit(hop).alias("hop"), "parent")
        found = found.unionByName(new)
        met = cut(met.unionByName(new)) if hop % 8 == 0 else met.unionByName(new)
        front = front.select(*key, "node", "place")
    raise RuntimeError(f"paths did not end in {rounds} rounds")


def path_steps(pairs: DataFrame, uses: DataFrame, kinds: DataFrame | None = None, rounds: int = 100_000) -> DataFrame:
    """(pair_id, step, node, via): the shortest way from start to goal of each pair (pair_id, start, goal), one row for each node on it; of
    several ways the one with the smallest ids, the first step first. No rows where there is none; one where both are the same.

    ``via`` is the kind of the edge that leads to the node by ``kinds`` (source, target, kind), else ``depends-on``, null on the first.
    One search for each start serves all its goals; ways are read back from the goals by joins with the search's predecessors.
    """
    goals = pairs.select(*G, "start", F.col("goal").alias("node")).distinct()
    came = cut(predecessors(pairs, uses, goals))
    at = cut(pairs.select(*G, "pair_id", "start", F.col("goal").alias("node")).join(came, [*G, "start", "node"]))
    out = []
    for _ in range(rounds):
        out.append(at.select(*G, "pair_id", F.col("hop").alias("step"), "node", "parent"))
        at = at.where("parent is not null").select(*G, "pair_id", "start", F.col("parent").alias("node")).join(came, [*G, "start", "node"])
        at = cut(at)
        if not at.take(1):
            break
    rows = reduce(DataFrame.unionByName, out)
    if kinds is not None:
        rows = rows.join(kinds.select(*G, F.col("source").alias("parent"), F.col("target").alias("node"), "kind"), [*G, "parent", "node"], "left")
    via = F.when(F.col("parent").isNotNull(), F.coalesce(F.col("kind") if kinds is not None else F.lit(None), F.lit("depends-on")))
    return rows.select("pair_id", "step", "node", via.alias("via"))


def shortest_paths(pairs: DataFrame, uses: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """(pair_id, steps, nodes, kinds): the steps of each pair's way in one row; a way has no node twice."""
    row = F.array_sort(F.collect_list(F.struct("step", "node", "via")))
    rows = path_steps(pairs, uses, kinds).groupBy("pair_id").agg(row.alias("r"))
    return rows.select("pair_id", F.size("r").alias("steps"), F.array_join("r.node", ">").alias("nodes"), F.array_join("r.via", ">").alias("kinds"))


def path_endpoints(counts: DataFrame) -> DataFrame:
    return counts.select(*G, "symbol", (F.col("uses") > 0).alias("can_from"), (F.col("used_by") > 0).alias("can_to"))


def neighbourhood(edges: DataFrame, focus: DataFrame, most: int = NEIGHBOURS) -> DataFrame:
    """(focus, rank, node, total): neighbours in both directions, ``most`` of them, and how many there are."""
    both = edges.select(*G, F.col("source").alias("focus"), F.col("target").alias("node")).unionAll(edges.select(*G, F.col("target").alias("focus"), F.col("source").alias("node")))
    near = both.join(focus.select(*G, "focus").distinct(), [*G, "focus"], "left_semi").where("node != focus").distinct()
    near = near.withColumn("total", F.count("*").over(Window.partitionBy(*G, "focus")))
    return top(near, [*G, "focus"], [F.asc("node")], most).select(*G, "focus", "rank", "node", "total")


def filter_graph(nodes: DataFrame, edges: DataFrame, node_kinds: list[str], edge_kinds: list[str], pinned: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, hidden counts): nodes of the kinds and the pinned one, edges of the kinds with both ends kept."""
    keep = F.col("kind").isin(*node_kinds) | (F.col("id") == F.lit(pinned) if pinned else F.lit(False))
    n = nodes.where(keep)
    e = edges.where(F.col("kind").isin(*edge_kinds))
    for end in ("source", "target"):
        e = e.join(n.select(*G, F.col("id").alias(end)), [*G, end], "left_semi")
    count = lambda d, c: d.groupBy(*G).agg(F.count("*").alias(c))
    rows = count(nodes, "an").join(count(n, "kn"), list(G), "left").join(count(edges, "ae"), list(G), "left").join(count(e, "ke"), list(G), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return n, e, rows.select(*G, (zero("an") - zero("kn")).alias("hidden_nodes"), (zero("ae") - zero("ke")).alias("hidden_edges"))


#: Parts of a label index by gram; a search reads those of its queries' grams.
GRAM_PARTS = 64


@dataclass(frozen=True)
class LabelIndex:
    """grams: part, gram, then G, id and label for each two and three characters in a row of a label; sizes: gram, n labels with it."""

    grams: DataFrame
    sizes: DataFrame


def label_index(nodes: DataFrame, path: str) -> LabelIndex:
    """The grams of all labels, written below ``path`` once for any number of searches; labels of under two characters have none."""
    label, spark = F.lower("label"), nodes.sparkSession
    of = lambda n: F.when(F.length(label) >= n, F.transform(F.sequence(F.lit(1), F.length(label) - (n - 1)), lambda i: F.substring(label, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    rows = nodes.where("label is not null").select(*G, "id", "label", F.explode(F.array_distinct(F.concat(of(2), of(3)))).alias("gram"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(GRAM_PARTS)).cast("int"))
    # a part in files by gram, so that a frequent gram does not make one task or file of its part
    rows.repartition("part", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{path}/grams")
    grams = spark.read.schema(rows.schema).parquet(f"{path}/grams")
    grams.groupBy("gram").agg(F.count("*").alias("n")).write.parquet(f"{path}/sizes")
    return LabelIndex(grams, spark.read.parquet(f"{path}/sizes"))


def rank_matches(index: LabelIndex, queries: DataFrame, k: int = 12) -> DataFrame:
    """(query, rank, id, class): six classes of matches of a label and of its part behind the last slash, then shorter labels, then label
    and id. Queries have at least two characters.

    Every label that holds a query holds all of its grams, so only the labels under the query's rarest gram are looked at, and a query
    with a gram that no label has finds nothing. Rows behind the first ``k`` go in each task before they are shuffled.
    """
    q, label = F.col("_q"), F.lower("label")
    asked = queries.select("query", F.lower(F.trim("query")).alias("_q")).where(F.length("_q") >= 2).distinct()
    width = F.least(F.length(q), F.lit(3))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(q) - width + 1), lambda i: F.substring(q, i, width)))
    known = asked.select("query", "_q", F.size(grams).alias("_all"), F.explode(grams).alias("gram")).join(index.sizes, "gram")
    rarest = known.groupBy("query", "_q", "_all").agg(F.count("*").alias("_met"), F.min_by("gram", F.struct("n", "gram")).alias("gram")).where("_met = _all")
    rarest = rarest.select("query", "_q", "gram", F.pmod(F.xxhash64("gram"), F.lit(GRAM_PARTS)).cast("int").alias("part"))
    rows = index.grams.join(rarest, ["part", "gram"])
    base = F.element_at(F.split(label, "/"), -1)
    score = F.when(label == q, 0).when(base == q, 1).when(label.startswith(q), 2).when(base.startswith(q), 3).when(base.contains(q), 4).when(label.contains(q), 5)
    rows = rows.withColumn("class", score).where("class is not null")
    return top(rows, [*G, "query"], [F.asc("class"), F.length("label"), F.asc("label"), F.asc("id")], k).select(*G, "query", "rank", "id", "class")


def order_definitions(nodes: DataFrame, counts: DataFrame) -> DataFrame:
    """Definitions of a file: types, constants, functions, each by users and label."""
    kind = F.array_position(F.array(F.lit("type"), F.lit("constant"), F.lit("function")), F.col("kind"))
    rows = nodes.where("kind in ('type', 'constant', 'function')").join(counts.select(*G, F.col("symbol").alias("id"), "used_by"), [*G, "id"], "left").withColumn("used_by", F.coalesce("used_by", F.lit(0)))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*G, "path").orderBy(kind, F.desc("used_by"), "label", "id"))).select(*G, "path", "n", "id", "used_by")


def flows(entries: DataFrame, links: DataFrame, counts: DataFrame, steps: int = MOST_STEPS, least: int = LEAST_MODULES) -> DataFrame:
    """(path, step, module): greedy walks from each entry module to the linked module with the best score that the walk has not met.

    links (path, other, symbols); the score is symbols x 100 plus the users of the module, ties by name. Walks of fewer modules go.
    """
    score = links.join(counts, [*G, "other"], "left").select(*G, F.col("path").alias("at"), "other", (F.col("symbols") * 100 + F.coalesce("users", F.lit(0))).alias("score"))
    walk = cut(entries.select(*G, "path", F.col("path").alias("at"), F.array("path").alias("met")))
    done = []
    for _ in range(steps - 1):
        hop = walk.join(score, [*G, "at"]).where(~F.array_contains("met", F.col("other"))).groupBy(*G, "path").agg(F.min_by("other", F.struct(-F.col("score"), "other")).alias("other"))
        joined = cut(walk.join(hop, [*G, "path"], "left"))
        done.append(joined.where("other is null").select(*G, "path", "met"))
        walk = cut(joined.where("other is not null").select(*G, "path", F.col("other").alias("at"), F.array_append("met", F.col("other")).alias("met")))
        if not walk.take(1):
            break
    out = walk.select(*G, "path", "met")
    for d in done:
        out = out.unionByName(d)
    return out.where(F.size("met") >= least).select(*G, "path", (F.size("met") >= steps).alias("truncated"), F.posexplode("met").alias("step", "module"))


def callers_by_module(nodes: DataFrame, uses: DataFrame) -> DataFrame:
    """(symbol, path, callers): uses that have the path of their source (src) are not joined."""
    if "src" not in uses.columns:
        uses = uses.join(nodes.select(*G, F.col("id").alias("source"), F.col("path").alias("src")), [*G, "source"])
    return uses.where("src is not null").groupBy(*G, F.col("target").alias("symbol"), F.col("src").alias("path")).agg(F.count("*").alias("callers"))


def module_change_rollup(events: DataFrame) -> DataFrame:
    """Counts per module from tagged rows (path, tag)."""
    tags = ["added", "removed", "edited", "moved_in", "moved_out", "finding", "api_item", "impacted"]
    return events.groupBy(*G, "path").pivot("tag", tags).count().na.fill(0, tags)


def definitions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(file, n, symbol): what each file contains, without namespace anchors, by label and id."""
    from .overview import namespace_nodes

    held = edges.where("kind = 'contains'").select(*G, F.col("source").alias("file"), F.col("target").alias("id")).distinct()
    rows = held.join(nodes.select(*G, "id", "label"), [*G, "id"]).join(namespace_nodes(nodes), [*G, "id"], "left_anti")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(*G, "file").orderBy("label", "id"))).select(*G, "file", "n", F.col("id").alias("symbol"))
