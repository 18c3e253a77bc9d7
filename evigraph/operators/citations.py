"""Validation of cited claims against what was measured.

citations: doc_id, section_id, claim_no, cite_no, kind, key, path, start_line, end_line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import top

CLAIM = ["doc_id", "section_id", "claim_no"]


def citable_universe(files: DataFrame, edges: DataFrame, items: DataFrame, impact: DataFrame) -> DataFrame:
    """(kind, key, lines): one lookup of all that can be cited. files: path, lines; edges: id; items: item; impact: key."""
    rows = files.select(F.lit("source").alias("kind"), F.col("path").alias("key"), F.col("lines").cast("long").alias("lines"))
    for kind, side, column in (("graph-edge", edges, "id"), ("api-item", items, "item"), ("impact", impact, "key")):
        rows = rows.unionByName(side.select(F.lit(kind).alias("kind"), F.col(column).alias("key"), F.lit(None).cast("long").alias("lines")))
    return rows.groupBy("kind", "key").agg(F.max("lines").alias("lines"))


def cycle_key(members):
    """Exactly these members, in any order."""
    return F.array_join(F.array_sort(members), ",")


def resolve_citations(citations: DataFrame, universe: DataFrame) -> DataFrame:
    """citations with problem: null where it resolves."""
    key = F.when(F.col("kind") == "source", F.col("path")).otherwise(F.col("key"))
    rows = citations.withColumn("_key", key).join(universe.select("kind", F.col("key").alias("_key"), "lines", F.lit(True).alias("_found")), ["kind", "_key"], "left")
    source = F.col("kind") == "source"
    problem = (
        F.when(F.col("_found").isNull(), F.concat(F.lit("unknown "), F.col("kind")))
        .when(source & (F.col("end_line") < F.col("start_line")), "the range is reversed")
        .when(source & (F.coalesce("end_line", "start_line") > F.col("lines")), "the range ends behind the file")
    )
    return rows.withColumn("problem", problem).drop("_key", "_found", "lines")


def partition_claims(resolved: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """(claim, kept, good, reasons): kept with at least one citation that resolves, else the problems in the order of citations.

    ``claims`` adds those without any citation, which are dropped for that. The citations that a kept claim keeps are
    ``surviving_citations``. A claim has few citations.
    """
    good = F.count(F.when(F.col("problem").isNull(), 1))
    problems = F.array_sort(F.collect_list(F.when(F.col("problem").isNotNull(), F.struct("cite_no", "problem"))))
    rows = resolved.groupBy(*CLAIM).agg(good.alias("good"), F.array_join(F.transform(problems, lambda p: p["problem"]), "; ").alias("reasons"))
    if claims is not None:
        rows = claims.select(*CLAIM).distinct().join(rows, CLAIM, "left").withColumns({"good": F.coalesce("good", F.lit(0)), "reasons": F.coalesce("reasons", F.lit("no citations"))})
    return rows.select(*CLAIM, (F.col("good") > 0).alias("kept"), "good", F.when(F.col("good") == 0, F.col("reasons")).alias("reasons"))


def surviving_citations(resolved: DataFrame) -> DataFrame:
    """The citations that resolve, in their claims; a claim with one of them is kept with these alone."""
    return resolved.where("problem is null").drop("problem")


def validated_document(claims: DataFrame) -> DataFrame:
    """(doc_id, sections, kept, dropped, note): empty sections vanish; a document of which nothing is left gets a note."""
    rows = claims.groupBy("doc_id").agg(F.count_distinct(F.when(F.col("kept"), F.col("section_id"))).alias("sections"), F.count(F.when(F.col("kept"), 1)).alias("kept"), F.count(F.when(~F.col("kept"), 1)).alias("dropped"))
    return rows.withColumn("note", F.when(F.col("kept") == 0, "nothing could be verified"))


# Sections that a narrative should have.
SECTIONS = ("what", "structure", "entry", "hotspots", "caution")


def density_notes(resolved: DataFrame, files: DataFrame, least: int = 5, canonical: tuple[str, ...] = SECTIONS) -> DataFrame:
    """(doc_id, note): what a document that kept a section leaves thin: fewer distinct files cited than ``least`` or all there are, and
    canonical sections of which nothing was kept."""
    kept = surviving_citations(resolved)
    n = kept.groupBy("doc_id").agg(F.count_distinct(F.when(F.col("kind") == "source", F.col("path"))).alias("cited"), F.collect_set(F.when(F.col("section_id").isin(*canonical), F.col("section_id"))).alias("present"))
    rows = n.join(F.broadcast(files.agg(F.count_distinct("path").alias("files"))))  # one row
    absent = F.array_except(F.array(*map(F.lit, canonical)), "present")
    thin = F.when(F.col("cited") < F.least(F.col("files"), F.lit(least)), F.concat(F.lit("narrative cites only "), F.col("cited").cast("string"), F.lit(" distinct file(s) of "), F.col("files").cast("string"), F.lit("; it may describe less of the project than it appears to")))
    missing = F.when(F.size(absent) > 0, F.concat(F.lit("narrative sections absent: "), F.array_join(absent, ", ")))
    return rows.select("doc_id", F.explode(F.array_compact(F.array(thin, missing))).alias("note"))


def condense(claims: DataFrame, k: int = 6) -> DataFrame:
    """The first ``k`` kept claims of each document in the order of sections, and how many remain."""
    kept = claims.where("kept").withColumn("total", F.count("*").over(Window.partitionBy("doc_id")))
    return top(kept, ["doc_id"], [F.asc("section_id"), F.asc("claim_no")], k).select(*CLAIM, "rank", F.greatest(F.col("total") - k, F.lit(0)).alias("remainder"))


def evidence_problem(rows: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """``rows`` (path, symbol, start_line, end_line of a piece of evidence) with problem: null where it resolves.

    files: path, lines (null where they weren't counted); symbols: id. A row without a path has no evidence and no problem.
    """
    known = files.select("path", F.col("lines").alias("_lines"), F.lit(True).alias("_found")).dropDuplicates(["path"])
    named = symbols.select(F.col("id").alias("symbol"), F.lit(True).alias("_named")).distinct()
    out = rows.join(known, "path", "left").join(named, "symbol", "left")
    place = F.concat("path", F.lit(":"), F.col("start_line").cast("string"))
    late = lambda c: F.when(F.col(c) > F.col("_lines"), F.concat("path", F.lit(":"), F.col(c).cast("string"), F.lit(" is past the end of the file ("), F.col("_lines").cast("string"), F.lit(" lines)")))
    problem = (
        F.when(F.col("path").isNull(), None)
        .when(F.col("_found").isNull(), F.concat("path", F.lit(" does not exist at this revision")))
        .when(F.col("symbol").isNotNull() & F.col("_named").isNull(), F.concat("symbol", F.lit(" is not a symbol this run's graph contains")))
        .when(F.col("end_line") < F.col("start_line"), F.concat(place, F.lit("-"), F.col("end_line").cast("string"), F.lit(" ends before it begins")))
        .otherwise(F.coalesce(late("start_line"), late("end_line")))
    )
    return out.withColumn("problem", problem).select(*rows.columns, "problem")


PROOF = ("path", "symbol", "start_line", "end_line")


def validate_protocol(elements: DataFrame, states: DataFrame, files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements with reason, documents with note) of protocol models; a null reason keeps an element.

    elements: doc_id, kind (participant, message, timeout), name, producer, consumer, and the evidence (path, symbol, start_line,
    end_line); states: doc_id, state. Participants need evidence that resolves; messages too, and both of their participants; a timeout,
    named by its state, a state that the document declares. A document of which no participant is left has nothing.
    """
    rows = evidence_problem(elements, files, symbols)
    alive = rows.where("kind = 'participant' and problem is null").select("doc_id", "name").distinct()
    for end in ("producer", "consumer"):
        rows = rows.join(alive.select("doc_id", F.col("name").alias(end), F.lit(True).alias(f"_{end}")), ["doc_id", end], "left")
    rows = rows.join(states.select("doc_id", F.col("state").alias("name"), F.lit("timeout").alias("kind"), F.lit(True).alias("_state")).distinct(), ["doc_id", "kind", "name"], "left")
    gone = F.when(F.col("_producer").isNull(), F.col("producer")).when(F.col("_consumer").isNull(), F.col("consumer"))
    lost = F.when(F.col("kind") == "message", F.concat(F.lit("its participant '"), gone, F.lit("' did not survive validation")))
    no_state = F.when((F.col("kind") == "timeout") & F.col("_state").isNull(), F.concat(F.lit("its state '"), "name", F.lit("' is not one this protocol declares")))
    rows = rows.select(*elements.columns, F.coalesce("problem", lost, no_state).alias("reason"))
    left = rows.groupBy("doc_id").agg(F.count(F.when((F.col("kind") == "participant") & F.col("reason").isNull(), 1)).alias("participants"))
    return rows, left.withColumn("note", F.when(F.col("participants") == 0, "nothing could be verified"))


def validate_threats(elements: DataFrame, between: DataFrame, threats: DataFrame, files: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements with reason and verified, threats of focus paths) of threat models; a null reason keeps an element.

    elements: doc_id, kind (component, boundary, control, focus), name, evidence_no and the evidence; a boundary has a row for each piece.
    between: doc_id, name, component: the ends of boundaries. threats: doc_id, focus (a path), threat_id, known.
    Components need evidence that resolves; boundaries all of their ends, and one piece that does (the others go, the reason is that of
    the first). A control is verified if its evidence resolves; otherwise its claim stays without it. Focus paths must be known, and
    exactly one that is left of a document is dropped; threats that the model doesn't have are taken off them.
    """
    rows = evidence_problem(elements, files, symbols)
    alive = rows.where("kind = 'component' and problem is null").select("doc_id", F.col("name").alias("component")).distinct()
    lost = between.join(alive, ["doc_id", "component"], "left_anti").groupBy("doc_id", "name").agg(F.min("component").alias("_gone")).withColumn("kind", F.lit("boundary"))
    rows = rows.join(lost, ["doc_id", "kind", "name"], "left")
    whole = Window.partitionBy("doc_id", "kind", "name")
    good = F.count(F.when(F.col("problem").isNull(), 1)).over(whole)
    first = F.first("problem").over(whole.orderBy("evidence_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    focus = F.col("kind") == "focus"
    left = F.size(F.collect_set(F.when(focus & F.col("problem").isNull(), F.col("name"))).over(Window.partitionBy("doc_id", "kind")))
    boundary = F.when(F.col("_gone").isNotNull(), F.concat(F.lit("its component '"), "_gone", F.lit("' did not survive validation"))).when(good == 0, first).when(F.col("problem").isNotNull(), F.concat(F.lit("taken off: "), "problem"))
    reason = F.when(F.col("kind") == "boundary", boundary).when(focus & F.col("problem").isNull() & (left == 1), "the only focus path left").otherwise(F.col("problem"))
    rows = rows.withColumns({"reason": reason, "verified": F.when(F.col("kind") == "control", F.col("path").isNotNull() & F.col("problem").isNull())})
    kept = rows.where(focus & F.col("reason").isNull()).select("doc_id", F.col("name").alias("focus")).distinct()
    return rows.select(*elements.columns, "reason", "verified"), threats.where("known").join(kept, ["doc_id", "focus"], "left_semi").select("doc_id", "focus", "threat_id")


def answer_memo(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """questions with the artifact of a known answer; null for new ones. Both have memo and role."""
    return questions.join(answers.groupBy("memo").agg(F.max("sha256").alias("sha256")), "memo", "left").withColumn("cached", F.col("sha256").isNotNull())


def resolve_project_citations(citations: DataFrame, modules: DataFrame, packages: DataFrame, cycles: DataFrame, files: DataFrame) -> DataFrame:
    """citations (kind: module, package, cycle, source; key, members) with problem. A cycle must have exactly the cited members.

    modules: path; packages: package; cycles: members (array); files: path, lines.
    """
    none = F.lit(None).cast("long").alias("lines")
    sides = [(modules, "module", F.col("path"), none), (packages, "package", F.col("package"), none), (cycles, "cycle", cycle_key(F.col("members")), none), (files, "source", F.col("path"), F.col("lines").cast("long").alias("lines"))]
    universe = None
    for rows, kind, key, lines in sides:
        part = rows.select(F.lit(kind).alias("kind"), key.alias("key"), lines).distinct()
        universe = part if universe is None else universe.unionByName(part)
    return resolve_citations(citations.withColumn("key", F.when(F.col("kind") == "cycle", cycle_key(F.col("members"))).otherwise(F.col("key"))), universe)
