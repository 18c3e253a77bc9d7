"""Module tables, dependencies, cycles, levels and rankings of a graph snapshot.

nodes: repository_id, revision, id, kind, label, path, start_line, end_line, public. edges: repository_id, revision, source, target,
kind. deps: repository_id, revision, src, dst (module paths).
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import G, ancestors, cut, owner_by_prefix, top

#: Edge kinds that make one module depend on another (fixed vocabulary).
MODULE_KINDS = ("calls", "reads", "imports", "depends-on")
SYMBOL_KINDS = ("function", "type", "module", "constant")


def namespace_nodes(nodes: DataFrame) -> DataFrame:
    """Ids of namespace anchors: modules and descriptors directly below crate/, super/ or self/."""
    return nodes.where((F.col("kind") == "module") | F.regexp_extract("id", r" (crate|super|self)/$", 1).isin("crate", "super", "self")).select(*G, "id")


#: Ids of anchors that are sent to all tasks; more are joined by their key.
FEW_ANCHORS = 100_000


def without_anchors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges without an end that is an anchor; few anchors, counted first, spare both shuffles of the edges, and none spare the joins."""
    anchors = cut(namespace_nodes(nodes))
    n = anchors.count()
    for end in ("source", "target") if n else ():
        gone = anchors.withColumnRenamed("id", end)
        edges = edges.join(F.broadcast(gone) if n <= FEW_ANCHORS else gone, [*G, end], "left_anti")
    return edges


def module_table(nodes: DataFrame) -> DataFrame:
    """Symbols per module by kind; public_count is null where the snapshot never measured visibility."""
    files = nodes.where("kind = 'file'").select(*G, "path").distinct()
    symbols = nodes.where(F.col("kind").isin(*SYMBOL_KINDS))
    counts = symbols.groupBy(*G, "path").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}s") for k in SYMBOL_KINDS), F.count("*").alias("symbols"), F.count(F.when(F.col("public"), 1)).alias("public_symbols"))
    measured = nodes.groupBy(*G).agg(F.bool_or(F.col("public").isNotNull()).alias("measured"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in (*(f"{k}s" for k in SYMBOL_KINDS), "symbols")]
    return files.join(counts, [*G, "path"], "left").join(measured, list(G)).select(*G, "path", *zero, F.when(F.col("measured"), F.coalesce("public_symbols", F.lit(0))).alias("public_count"))


def package_of(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(path, package) by the longest directory prefix; a package in the root (empty directory) owns what is left."""
    return owner_by_prefix(files.select(*G, "path"), packages.select(*G, "directory", "package"), list(G))


def package_summary(modules: DataFrame, owners: DataFrame) -> DataFrame:
    return modules.join(owners, [*G, "path"]).where("package is not null").groupBy(*G, "package").agg(F.count("*").alias("files"), F.sum("symbols").alias("symbols"))


def path_edges(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Edges of the kinds between different modules, with their paths src and dst; edges that have these already are not joined again."""
    edges = without_anchors(nodes, edges.where(F.col("kind").isin(*kinds)))
    if not {"src", "dst"} <= set(edges.columns):
        place = nodes.where("path is not null").select(*G, "id", "path")
        edges = edges.join(place.withColumnsRenamed({"id": "source", "path": "src"}), [*G, "source"]).join(place.withColumnsRenamed({"id": "target", "path": "dst"}), [*G, "target"])
    return edges.where("src != dst")


def module_deps(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = MODULE_KINDS) -> DataFrame:
    return path_edges(nodes, edges, kinds).select(*G, "src", "dst").distinct()


def weighted_deps(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = MODULE_KINDS) -> DataFrame:
    """Module pairs and the number of symbol edges behind each."""
    return path_edges(nodes, edges, kinds).groupBy(*G, "src", "dst").agg(F.count("*").alias("weight"))


def fan_counts(deps: DataFrame, modules: DataFrame) -> DataFrame:
    out = deps.groupBy(*G, F.col("src").alias("path")).agg(F.count_distinct("dst").alias("fan_out"))
    into = deps.groupBy(*G, F.col("dst").alias("path")).agg(F.count_distinct("src").alias("fan_in"))
    both = modules.select(*G, "path").join(into, [*G, "path"], "left").join(out, [*G, "path"], "left")
    return both.select(*G, "path", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


#: Rows (modules and dependencies) of a snapshot that one task works on as a whole.
AT_ONCE = 500_000


def strong_components(n: int, out: list[list[int]]) -> tuple[list[int], list[int]]:
    """The component of each of ``n`` nodes, and its level: 0 without arcs to other components, else one more than the highest there.

    A depth-first search finds a component after all that it depends on, so its level is known as soon as it is complete.
    """
    low, order, comp, level, stack, met = [0] * n, [-1] * n, [-1] * n, [], [], 0
    for root in range(n):
        work = [(root, 0)] if order[root] < 0 else []
        while work:
            v, k = work.pop()
            if k == 0:
                order[v] = low[v] = met
                met += 1
                stack.append(v)
            elif comp[out[v][k - 1]] < 0:
                low[v] = min(low[v], low[out[v][k - 1]])
            while k < len(out[v]) and order[out[v][k]] >= 0:
                if comp[out[v][k]] < 0:
                    low[v] = min(low[v], order[out[v][k]])
                k += 1
            if k < len(out[v]):
                work += ((v, k + 1), (out[v][k], 0))
            elif low[v] == order[v]:
                c, members = len(level), []
                while comp[v] < 0:
                    members.append(stack.pop())
                    comp[members[-1]] = c
                level.append(max((level[comp[w]] + 1 for m in members for w in out[m] if comp[w] != c), default=0))
    return comp, [level[c] for c in comp]


def _layered(rows: pa.Table) -> pa.Table:
    """Components and levels of one snapshot: rows with dst are dependencies, others modules."""
    names = pc.unique(pa.chunked_array([*rows["src"].chunks, *rows["dst"].drop_null().chunks]))
    names = names.take(pc.sort_indices(names))  # so that the smallest number is the smallest name
    src, dst = (pc.index_in(rows[c].combine_chunks(), value_set=names).to_pylist() for c in ("src", "dst"))
    out: list[list[int]] = [[] for _ in range(len(names))]
    for a, b in zip(src, dst):
        if b is not None:
            out[a].append(b)
    comp, level = strong_components(len(names), out)
    least: dict[int, int] = {}
    for i, c in enumerate(comp):
        least.setdefault(c, i)
    known = [i for i, b in zip(src, dst) if b is None]
    keys = [pa.array([rows[g][0].as_py()] * len(known), rows.schema.field(g).type) for g in G]
    take = lambda at: names.take(pa.array(at, pa.int64())).cast(pa.string())
    return pa.table([*keys, take(known), take([least[comp[i]] for i in known]), pa.array([level[i] for i in known], pa.int32())], names=[*G, "path", "component", "level"])


def layered(deps: DataFrame, modules: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(path, component, level) of all modules: strongly connected components, named by their smallest member, and their levels: 0 without
    dependencies, else one more than the highest level depended on.

    A snapshot of at most ``at_once`` modules and dependencies is searched by one task, in one pass, whatever its depth. Larger ones
    are worked on by all tasks, in rounds (``scc_in_rounds``, ``levels_in_rounds``), so no snapshot is too large for a task. Both ends
    of a dependency are modules.
    """
    edges = deps.where("src != dst").select(*G, "src", "dst").distinct()
    rows = cut(edges.unionByName(modules.select(*G, F.col("path").alias("src"), F.lit(None).cast("string").alias("dst")).distinct()))
    # counted before anything is gathered
    n = rows.groupBy(*G).agg((F.count("*") > at_once).alias("large"))
    small, large = (n.where(x).select(*G) for x in (~F.col("large"), F.col("large")))
    done = rows.join(small, list(G)).groupBy(*G).applyInArrow(_layered, "repository_id string, revision string, path string, component string, level int")
    if not large.take(1):
        return done
    rows = cut(rows.join(large, list(G), "left_semi"))
    edges, nodes = rows.where("dst is not null"), rows.where("dst is null").select(*G, F.col("src").alias("path"))
    return done.unionByName(levels_in_rounds(edges, scc_in_rounds(edges, nodes)))


def scc(deps: DataFrame, modules: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(path, component): strongly connected components, named by their smallest member; see ``layered``."""
    return layered(deps, modules, at_once).drop("level")


def scc_in_rounds(deps: DataFrame, modules: DataFrame, rounds: int = 500) -> DataFrame:
    """(path, component) of snapshots of any size.

    Nodes without open edges on one side are peeled off; the smallest id is then propagated along the edges, and from each node that
    kept its own id its component is what reaches it backwards within its colour. All snapshots run in the same rounds.
    """
    edges = cut(deps.where("src != dst").select(*G, "src", "dst").distinct())
    left = cut(modules.select(*G, "path").distinct())
    done = []
    for _ in range(rounds):
        # trim: one pass tells which nodes have open edges on both sides
        while True:
            ends = edges.select(*G, F.col("dst").alias("path"), F.lit(True).alias("into"), F.lit(False).alias("out")).unionAll(edges.select(*G, "src", F.lit(False), F.lit(True)))
            state = left.withColumns({"into": F.lit(False), "out": F.lit(False)}).unionByName(ends).groupBy(*G, "path").agg((F.bool_or("into") & F.bool_or("out")).alias("core"))
            state = cut(state)
            gone = state.where("not core").select(*G, "path")
            if not gone.take(1):
                break
            done.append(gone.withColumn("component", F.col("path")))
            left = state.where("core").select(*G, "path")
            edges = cut(_inside(edges, left))
        if not left.take(1):
            break
        colour = _spread(left.select(*G, "path", F.col("path").alias("colour")), edges)
        same = edges.join(colour.withColumnsRenamed({"path": "src", "colour": "a"}), [*G, "src"]).join(colour.withColumnsRenamed({"path": "dst", "colour": "b"}), [*G, "dst"]).where("a = b")
        same = cut(same.select(*G, "src", "dst"))
        found = cut(colour.where("path = colour"))
        while True:
            back = found.withColumnRenamed("path", "dst").join(same, [*G, "dst"]).select(*G, F.col("src").alias("path"), "colour").distinct()
            new = cut(back.join(found, [*G, "path"], "left_anti"))
            if not new.take(1):
                break
            found = cut(found.unionByName(new))
        done.append(found.withColumnRenamed("colour", "component"))
        left = cut(left.join(found, [*G, "path"], "left_anti"))
        edges = cut(_inside(edges, left))
    else:
        raise RuntimeError("components did not settle")
    out = left.withColumn("component", F.col("path"))
    for d in done:
        out = out.unionByName(d.select(*G, "path", "component"))
    return out


def _inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.withColumnRenamed("path", "src"), [*G, "src"], "left_semi").join(nodes.withColumnRenamed("path", "dst"), [*G, "dst"], "left_semi").select(*G, "src", "dst")


def _spread(colour: DataFrame, edges: DataFrame) -> DataFrame:
    """The smallest colour that reaches each node; a round ends with who changed, so that the end is seen without another join."""
    colour = cut(colour.withColumn("changed", F.lit(True)))
    while True:
        moved = edges.join(colour.where("changed").withColumnRenamed("path", "src"), [*G, "src"]).select(*G, F.col("dst").alias("path"), "colour", F.lit(None).cast("string").alias("old"))
        both = colour.select(*G, "path", "colour", F.col("colour").alias("old")).unionByName(moved).groupBy(*G, "path").agg(F.min("colour").alias("colour"), F.max("old").alias("old"))
        colour = cut(both.select(*G, "path", "colour", (F.col("colour") != F.col("old")).alias("changed")))
        if not colour.where("changed").take(1):
            return colour.drop("changed")


def levelize(deps: DataFrame, comps: DataFrame, at_once: int = AT_ONCE) -> DataFrame:
    """(path, component, level) over known components: 0 without dependencies, else one more than the highest level depended on."""
    a, b = (comps.select(*G, F.col("path").alias(end), F.col("component").alias(c)) for end, c in (("src", "a"), ("dst", "b")))
    arcs = deps.join(a, [*G, "src"]).join(b, [*G, "dst"]).where("a != b").select(*G, F.col("a").alias("src"), F.col("b").alias("dst"))
    level = layered(arcs, comps.select(*G, F.col("component").alias("path")), at_once).select(*G, F.col("path").alias("component"), "level")
    return comps.join(level, [*G, "component"]).select(*G, "path", "component", "level")


def levels_in_rounds(deps: DataFrame, comps: DataFrame, rounds: int = 10000) -> DataFrame:
    """(path, component, level) of snapshots of any size.

    A component with one arc only is one level above its end, so chains of such are first led to where they end, by pointers that double
    their steps; a round then follows the arcs, longer by what they lead over, into components whose level has just risen, no others.
    """
    a, b = (comps.select(*G, F.col("path").alias(end), F.col("component").alias(c)) for end, c in (("src", "a"), ("dst", "b")))
    arcs = cut(deps.join(a, [*G, "src"]).join(b, [*G, "dst"]).where("a != b").select(*G, "a", "b").distinct().withColumn("long", F.lit(1)))
    over = []
    while True:
        # components with one arc: their end and how far it is; doubled until the end is one with no arc or with several
        one = cut(arcs.groupBy(*G, "a").agg(F.count("*").alias("n"), F.min("b").alias("b"), F.min("long").alias("long")).where("n = 1").drop("n"))
        inner = one.join(one.select(*G, F.col("a").alias("b")), [*G, "b"], "left_semi")
        if not inner.take(1):
            break
        ends = one
        while True:
            far = ends.select(*G, F.col("a").alias("b"), F.col("b").alias("c"), F.col("long").alias("more"))
            ends = cut(ends.join(far, [*G, "b"], "left").select(*G, "a", F.coalesce("c", "b").alias("b"), (F.col("long") + F.coalesce("more", F.lit(0))).alias("long"), F.col("c").isNotNull().alias("moved")))
            moved = ends.where("moved").take(1)
            ends = ends.drop("moved")
            if not moved:
                break
        over.append(ends)
        # arcs into such components lead to where these end; of parallel arcs the longest counts
        rest = arcs.join(ends.select(*G, "a"), [*G, "a"], "left_anti")
        past = ends.select(*G, F.col("a").alias("b"), F.col("b").alias("c"), F.col("long").alias("more"))
        rest = rest.join(past, [*G, "b"], "left").select(*G, "a", F.coalesce("c", "b").alias("b"), (F.col("long") + F.coalesce("more", F.lit(0))).alias("long"))
        arcs = cut(rest.groupBy(*G, "a", "b").agg(F.max("long").alias("long")))
    gone = [e.select(*G, F.col("a").alias("component")) for e in over]
    level = comps.select(*G, "component").distinct()
    for g in gone:
        level = level.join(g, [*G, "component"], "left_anti")
    level = cut(level.withColumns({"level": F.lit(0), "risen": F.lit(True)}))
    for _ in range(rounds):
        up = arcs.join(level.where("risen").withColumnRenamed("component", "b"), [*G, "b"]).groupBy(*G, F.col("a").alias("component")).agg(F.max(F.col("level") + F.col("long")).alias("up"))
        level = level.join(up, [*G, "component"], "left").withColumn("risen", F.coalesce(F.col("up") > F.col("level"), F.lit(False)))
        level = cut(level.select(*G, "component", F.greatest("level", "up").alias("level"), "risen"))
        if not level.where("risen").take(1):
            break
    else:
        raise RuntimeError("levels did not settle")
    level = level.drop("risen")
    for e in reversed(over):
        level = level.unionByName(e.join(level.withColumnRenamed("component", "b"), [*G, "b"]).select(*G, F.col("a").alias("component"), (F.col("level") + F.col("long")).alias("level")))
    return comps.join(level, [*G, "component"]).select(*G, "path", "component", "level")


def level_summary(levels: DataFrame) -> DataFrame:
    return levels.groupBy(*G, "level").agg(F.count("*").alias("modules"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("members"))


def cycles(comps: DataFrame, deps: DataFrame) -> DataFrame:
    """Components of two modules and more: members and the number of edges inside."""
    members = comps.groupBy(*G, "component").agg(F.count("*").alias("size"), F.array_join(F.array_sort(F.collect_list("path")), ",").alias("members")).where("size >= 2")
    a, b = (comps.select(*G, F.col("path").alias(end), F.col("component").alias(c)) for end, c in (("src", "a"), ("dst", "b")))
    inside = deps.join(a, [*G, "src"]).join(b, [*G, "dst"]).where("a = b").groupBy(*G, F.col("a").alias("component")).agg(F.count("*").alias("edges"))
    return members.join(inside, [*G, "component"], "left").select(*G, "component", "size", "members", F.coalesce("edges", F.lit(0)).alias("edges"))


def hubs(fans: DataFrame, levels: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` modules with the most users and the most dependencies, ties by level and path."""
    both = fans.join(levels, [*G, "path"])
    lists = [top(both.where(F.col(c) > 0), list(G), [F.desc(c), F.asc("level"), F.asc("path")], k).select(*G, F.lit(c).alias("list"), "rank", "path", F.col(c).alias("n")) for c in ("fan_in", "fan_out")]
    return lists[0].unionByName(lists[1])


def orphans(fans: DataFrame) -> DataFrame:
    return fans.where("fan_in = 0 and fan_out = 0").select(*G, "path")


# Names of files that a program or its callers enter through, and directories beside it.
LIBRARY_ROOTS, BINARY_ROOTS, BUILD_SCRIPTS = ("lib.rs", "__init__.py", "index.ts", "index.js"), ("main.rs",), ("build.rs",)
BESIDE = r"(^|/)(examples|benches|tests)/"


def entry_points(nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, reason) of modules: those with a function called main, and binary and library roots; build scripts aren't part of a program."""
    name = F.element_at(F.split("path", "/"), -1)
    known = modules.select(*G, "path").distinct().where(~name.isin(*BUILD_SCRIPTS))
    where = F.when(F.col("path").rlike(BESIDE), "example or test").otherwise("program")
    mains = nodes.where("kind = 'function' and label = 'main'").select(*G, "path").join(known, [*G, "path"], "left_semi").withColumn("reason", F.concat(F.lit("defines `main` ("), where, F.lit(")")))
    root = F.when(name.isin(*BINARY_ROOTS), F.concat(F.lit("binary root ("), name, F.lit(")"))).when(name.isin(*LIBRARY_ROOTS), F.concat(F.lit("library root ("), name, F.lit(")")))
    rows = mains.unionByName(known.withColumn("reason", root).where("reason is not null"))
    return rows.groupBy(*G, "path").agg(F.concat_ws("; ", F.array_sort(F.collect_set("reason"))).alias("reason"))


def start_here(entries: DataFrame, fans: DataFrame, levels: DataFrame, k: int = 7) -> DataFrame:
    """Where a program starts, by path, then modules by users, level and path: ``k`` in all.

    Entry points of examples and tests, and library roots, don't lead; like others they come in by their users.
    """
    program = ~F.col("path").rlike(BESIDE) & (F.col("reason").contains("binary root") | F.col("reason").contains("defines `main` (program)"))
    entries = entries.where(program)
    first = entries.select(*G, "path", F.lit(0).alias("section"), F.lit(0).cast("long").alias("fan"), F.lit(0).alias("level"))
    rest = fans.where("fan_in > 0").join(levels, [*G, "path"]).select(*G, "path", F.lit(1).alias("section"), F.col("fan_in").cast("long").alias("fan"), "level").join(entries, [*G, "path"], "left_anti")
    return top(first.unionByName(rest), list(G), [F.asc("section"), F.desc("fan"), F.asc("level"), F.asc("path")], k).select(*G, "rank", "path", "section")


def overview_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    kinds = nodes.groupBy(*G).agg(F.count(F.when(F.col("kind") == "package", 1)).alias("packages"), F.count(F.when(F.col("kind") == "file", 1)).alias("files"), F.count(F.when(F.col("kind").isin(*SYMBOL_KINDS), 1)).alias("symbols"))
    n = edges.groupBy(*G).agg(F.count("*").alias("edges"))
    return kinds.join(n, list(G), "left").select(*G, "packages", "files", "symbols", F.coalesce("edges", F.lit(0)).alias("edges"))


def depth_and_churn(modules: DataFrame, churn: DataFrame, k: int = 8) -> DataFrame:
    """Public symbols to symbols of the most changed modules; unmeasured churn (null) takes no part."""
    ranked = top(modules.join(churn, [*G, "path"]).where("commits is not null"), list(G), [F.desc("commits"), F.asc("path")], k)
    return ranked.select(*G, "rank", "path", "commits", F.concat_ws("/", "public_count", "symbols").alias("depth"), F.try_divide("public_count", "symbols").alias("ratio"))


def module_root(files: DataFrame) -> DataFrame:
    """The directory with the most files; ties go to the shorter, then the smaller name."""
    directory = F.array_join(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), "/")
    n = files.select(*G, directory.alias("directory")).groupBy(*G, "directory").agg(F.count("*").alias("files"))
    return top(n, list(G), [F.desc("files"), F.length("directory"), F.asc("directory")], 1).select(*G, "directory", "files")


#: Layer names that come first, in this order (fixed values), and names that are no layers.
PREFERRED_LAYERS = ("api", "handler", "service", "cache", "domain", "storage", "store", "db")
NO_LAYERS = ("lib", "main", "mod")


def layer_order(files: DataFrame, root: DataFrame, preferred: tuple[str, ...] = PREFERRED_LAYERS) -> DataFrame:
    """(layer, rank): files right below the root directory, preferred names first, the rest by name."""
    below = files.join(root, list(G)).where(F.col("path").startswith(F.concat("directory", F.lit("/"))))
    names = below.select(*G, F.regexp_replace(F.expr("substring(path, length(directory) + 2)"), r"\.rs$", "").alias("layer"))
    names = names.where(~F.col("layer").contains("/") & ~F.col("layer").isin(*NO_LAYERS)).distinct()
    first = F.coalesce(F.array_position(F.array(*map(F.lit, preferred)), F.col("layer")), F.lit(0))
    w = Window.partitionBy(*G).orderBy(F.when(first > 0, first).otherwise(len(preferred) + 1), "layer")
    return names.withColumn("rank", F.row_number().over(w))


def ranked_modules(modules: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` modules with the most symbols, and how many remain."""
    total = modules.groupBy(*G).agg(F.count("*").alias("total"))
    first = top(modules, list(G), [F.desc("symbols"), F.asc("path")], k).join(total, list(G))
    return first.select(*G, "rank", "path", "symbols", F.greatest(F.col("total") - k, F.lit(0)).alias("remainder"))


def tree_rollup(files: DataFrame) -> DataFrame:
    """(dir, files, dirs): files below each directory at any depth, and directories directly in it."""
    up = files.select(*G, "path", F.explode(ancestors(F.col("path"))).alias("dir"))
    counts = up.groupBy(*G, "dir").agg(F.count("*").alias("files"))
    child = up.where("dir != ''").select(*G, F.array_join(F.slice(F.split("dir", "/"), 1, F.size(F.split("dir", "/")) - 1), "/").alias("parent"), "dir").distinct()
    inner = child.groupBy(*G, F.col("parent").alias("dir")).agg(F.count("*").alias("dirs"))
    return counts.join(inner, [*G, "dir"], "left").select(*G, "dir", "files", F.coalesce("dirs", F.lit(0)).alias("dirs"))
