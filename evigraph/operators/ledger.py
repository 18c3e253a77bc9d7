"""Queries over the ledgers of runs, events, artifacts, costs and publications."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUN_CAP, TASK_CAP = 2_000_000, 400_000


def run_summaries(runs: DataFrame, revisions: DataFrame, snapshots: DataFrame) -> DataFrame:
    """runs (run_id, repository_id, kind, status, created_at, head_revision_id, base_revision_id) with the shas of their revisions
    (revision_id, sha) and the sizes of their graphs (snapshots: run_id, role, nodes, edges); a base graph counts only with a base."""
    rows = runs
    for role in ("head", "base"):
        sha = revisions.select(F.col("revision_id").alias(f"{role}_revision_id"), F.col("sha").alias(f"{role}_sha"))
        graph = snapshots.where(F.col("role") == role).select("run_id", F.col("nodes").alias(f"{role}_nodes"), F.col("edges").alias(f"{role}_edges"))
        rows = rows.join(sha, f"{role}_revision_id", "left").join(graph, "run_id", "left")
    based = [F.when(F.col("base_sha").isNotNull(), F.col(c)).alias(c) for c in ("base_nodes", "base_edges")]
    return rows.select("run_id", "repository_id", "kind", "status", "created_at", "head_sha", "base_sha", "head_nodes", "head_edges", *based)


def list_runs(runs: DataFrame, revisions: DataFrame, snapshots: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` newest runs, ids ascending in time, as ``run_summaries``."""
    return run_summaries(runs.orderBy(F.desc("run_id")).limit(n), revisions, snapshots)


def run_detail(summaries: DataFrame, events: DataFrame, receipts: DataFrame) -> DataFrame:
    """A row for each run with its events in order and its receipts (run_id, id, payload) in order, empty where it has none."""
    line = F.struct("seq", F.concat_ws(":", "stage", "event").alias("what"))
    detail = events.groupBy("run_id").agg(F.array_sort(F.collect_list(line)).alias("events"))
    proofs = receipts.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("id", "payload"))).alias("receipts"))
    rows = summaries.join(detail, "run_id", "left").join(proofs, "run_id", "left")
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    listed = lambda c, x: F.coalesce(F.array_join(F.transform(c, lambda e: e[x]), ","), F.lit(""))
    return rows.select(*summaries.columns, size("events").alias("n"), listed("events", "what").alias("events"), size("receipts").alias("n_receipts"), listed("receipts", "payload").alias("receipts"))


def artifact_for(run_artifacts: DataFrame, role: str) -> DataFrame:
    """The newest artifact of each run in a role."""
    return run_artifacts.where(F.col("role") == role).groupBy("run_id").agg(F.max_by("sha256", "id").alias("sha256"))


def answers(run_artifacts: DataFrame, prefix: str) -> DataFrame:
    return run_artifacts.where(F.col("role").startswith(prefix)).select("run_id", "role", "sha256")


def snapshot_conflicts(snapshots: DataFrame) -> DataFrame:
    """(run_id, role) with different hashes; the same one twice is none."""
    return snapshots.groupBy("run_id", "role").agg(F.count_distinct("hash").alias("hashes")).where("hashes > 1")


def graph_reuse(revisions: DataFrame, cache: DataFrame) -> DataFrame:
    """revisions (revision, fingerprint) with the run whose graph they can use: the first that wrote it."""
    first = cache.groupBy("revision", "fingerprint").agg(F.min_by("run_id", "id").alias("from_run"))
    return revisions.join(first, ["revision", "fingerprint"], "left").withColumn("hit", F.col("from_run").isNotNull())


def current_model(history: DataFrame) -> DataFrame:
    """All models of each repository in order, what each replaced and whether it is current."""
    w = Window.partitionBy("repository_id").orderBy("id")
    return history.select("repository_id", "id", "hash", F.lag("hash").over(w).alias("superseded"), F.lead("id").over(w).isNull().alias("current"))


def run_cost(invocations: DataFrame) -> DataFrame:
    """Token sums, cost (null where none was reported) and models of each run."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return invocations.groupBy("run_id").agg(zero("prompt_tokens").alias("prompt_tokens"), zero("completion_tokens").alias("completion_tokens"), F.sum("cost_usd").alias("cost_usd"), F.array_join(F.array_sort(F.collect_set("model_id")), ",").alias("models"))


def run_snapshot(status: DataFrame, cost: DataFrame) -> DataFrame:
    """Status counts per run, suppressed ones among the rejected, and the suppressed ones by themselves."""
    folded = F.when(F.col("status") == "suppressed", "rejected").otherwise(F.col("status"))
    n = status.groupBy("run_id", folded.alias("status")).agg(F.count("*").alias("n"), F.count(F.when(F.col("status") == "suppressed", 1)).alias("s"))
    maps = n.groupBy("run_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "status", "n"))), ",").alias("statuses"), F.sum("s").alias("suppressed"))
    return maps.join(cost, "run_id", "left")


#: Facts whose difference is noted but leaves two runs reproducible (fixed vocabulary).
NOTED = ("tokens", "cost", "suppressed")


def compare_runs(facts: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(differences, results) of pairs of runs (pair_id, run_a, run_b).

    facts: run_id, fact (revision, graph, toolchain, registry, findings, publishable, statuses, or one of ``NOTED``), key (the tool, id
    or status), value. differences: pair_id, fact, key, a, b, noted. results: pair_id, reproducible, differences, notes. Suppressed
    findings are noted wherever there are any.
    """
    a, b = (pairs.select("pair_id", F.col(c).alias("run_id")).join(facts, "run_id").select("pair_id", "fact", "key", F.col("value").alias(c[-1])) for c in ("run_a", "run_b"))
    rows = a.join(b, ["pair_id", "fact", "key"], "full")
    some = (F.col("fact") == "suppressed") & ((F.coalesce("a", F.lit("0")) != "0") | (F.coalesce("b", F.lit("0")) != "0"))
    rows = rows.where(some | ((F.col("fact") != "suppressed") & ~F.col("a").eqNullSafe(F.col("b")))).withColumn("noted", F.col("fact").isin(*NOTED))
    line = F.concat("fact", F.when(F.col("key") == "", "").otherwise(F.concat(F.lit(" "), "key")), F.lit(": "), F.coalesce("a", F.lit("absent")), F.lit(" vs "), F.coalesce("b", F.lit("absent")))
    said = lambda noted: F.array_join(F.array_sort(F.collect_list(F.when(F.col("noted") == F.lit(noted), F.col("_line")))), "; ")
    found = rows.withColumn("_line", line).groupBy("pair_id").agg(F.count(F.when(~F.col("noted"), 1)).alias("n"), said(False).alias("differences"), said(True).alias("notes"))
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows, pairs.select("pair_id").join(found, "pair_id", "left").select("pair_id", (F.coalesce("n", F.lit(0)) == 0).alias("reproducible"), empty("differences"), empty("notes"))


def budget(invocations: DataFrame, run_cap: int = RUN_CAP, task_cap: int = TASK_CAP) -> DataFrame:
    """Running totals of each run's tokens (seq, tokens), and the first invocation that breaks a cap."""
    w = Window.partitionBy("run_id").orderBy("seq")
    rows = invocations.withColumn("running", F.sum("tokens").over(w)).withColumn("over", (F.col("running") > run_cap) | (F.col("tokens") > task_cap))
    return rows.withColumn("breach", F.col("over") & (F.sum(F.col("over").cast("int")).over(w) == 1)).drop("over")


def run_status(runs: DataFrame, failures: DataFrame) -> DataFrame:
    f = failures.groupBy("run_id").agg(F.bool_or("fatal").alias("fatal"))
    return runs.join(f, "run_id", "left").select("run_id", F.when(F.col("fatal"), "failed").when(F.col("fatal").isNotNull(), "degraded").otherwise("completed").alias("status"))


def stage_timeline(events: DataFrame) -> DataFrame:
    """(run_id, stage, started, ended, outcome, seconds): the first start and the last end of each stage."""
    ended = F.col("event").isin("finished", "failed")
    rows = events.groupBy("run_id", "stage").agg(F.min(F.when(F.col("event") == "started", F.col("at"))).alias("started"), F.max(F.when(ended, F.col("at"))).alias("ended"), F.max_by("event", F.when(ended, F.col("seq"))).alias("outcome"))
    return rows.withColumn("micros", F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp")))


def verification_summary(diagnostics: DataFrame, tests: DataFrame) -> DataFrame:
    d = diagnostics.groupBy("run_id").agg(F.count("*").alias("diagnostics"), F.count(F.when(F.col("level") == "error", 1)).alias("errors"))
    t = tests.groupBy("run_id").agg(F.count("*").alias("tests"), F.count(F.when(F.col("status").isin("failed", "error"), 1)).alias("failing"))
    return d.join(t, "run_id", "full").na.fill(0)


def manifest(runs: DataFrame, receipts: DataFrame, artifacts: DataFrame, invocations: DataFrame, notes: DataFrame) -> DataFrame:
    """A row for each run (run_id, source_lock): its tools with versions, inputs, outputs by role with hashes (the newest of a role),
    token sums and cost (null where none was reported), models, and notes in order (run_id, seq, note)."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    tools = receipts.groupBy("run_id").agg(joined(F.concat_ws("=", "extractor", "extractor_version")).alias("tools"))
    newest = artifacts.groupBy("run_id", "role").agg(F.max_by("sha256", "id").alias("sha256"))
    outputs = newest.groupBy("run_id").agg(joined(F.concat_ws("=", "role", "sha256")).alias("outputs"))
    told = notes.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "note"))), lambda x: x["note"]), "; ").alias("notes"))
    rows = runs.select("run_id", F.concat(F.lit("sourceLock="), "source_lock").alias("inputs")).join(tools, "run_id", "left").join(outputs, "run_id", "left").join(run_cost(invocations), "run_id", "left").join(told, "run_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("prompt_tokens", "completion_tokens")]
    none = [F.coalesce(c, F.lit("")).alias(c) for c in ("tools", "outputs", "models", "notes")]
    return rows.select("run_id", "inputs", *none, *zero, "cost_usd")


def publication_audit(approvals: DataFrame, publications: DataFrame) -> DataFrame:
    """(approval_id, published, pending, failed, violation): more than one published row of an approval is one."""
    n = publications.groupBy("approval_id").agg(*(F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("published", "pending", "failed")))
    return approvals.select("approval_id").join(n, "approval_id", "left").na.fill(0).withColumn("violation", F.col("published") > 1)


def ledger_rows(table: DataFrame, run_id: str, order: list[str]) -> DataFrame:
    """The rows of one run with their place in code point order."""
    return table.where(F.col("run_id") == run_id).withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)))
