"""Small inputs with known results."""

from __future__ import annotations

import difflib
import random

import pytest
from pyspark.sql import functions as F

from evigraph.operators import citations as K
from evigraph.operators import contracts as V
from evigraph.operators import decisions as C
from evigraph.operators import diff as X
from evigraph.operators import findings as N
from evigraph.operators import graph_build as B
from evigraph.operators import impact as P
from evigraph.operators import overview as O
from evigraph.operators import paths as T
from evigraph.operators import views as W
from evigraph.operators.common import G, interval_join, ranked
from evigraph.sources import tables as S

DEPS = "repository_id string, revision string, src string, dst string"


def deps(spark, pairs):
    return spark.createDataFrame([("r", "1", a, b) for a, b in pairs], DEPS)


def modules(spark, names):
    return spark.createDataFrame([("r", "1", n) for n in names], "repository_id string, revision string, path string")


def test_clean_stack_levels(spark):
    d, m = deps(spark, [("api", "cache"), ("cache", "storage")]), modules(spark, ["api", "cache", "storage"])
    comps = O.scc(d, m)
    assert O.cycles(comps, d).count() == 0
    assert {r.path: r.level for r in O.levelize(d, comps).collect()} == {"storage": 0, "cache": 1, "api": 2}


def test_components_against_reachability(spark):
    rng = random.Random(8)
    names = [f"m{i:02d}" for i in range(24)]
    pairs = {(rng.choice(names), rng.choice(names)) for _ in range(34)}
    pairs = {(a, b) for a, b in pairs if a != b}
    reach = {n: {b for a, b in pairs if a == n} for n in names}
    for _ in names:
        for n in names:
            reach[n] |= {c for b in set(reach[n]) for c in reach[b]}
    want = {n: min([n, *(b for b in reach[n] if n in reach[b])]) for n in names}
    assert {r.path: r.component for r in O.scc(deps(spark, pairs), modules(spark, names)).collect()} == want


def test_levelized_view_counts_the_rest(spark):
    d, m = deps(spark, [("core/a", "core/b"), ("core/b", "core/a"), ("core/a", "core/c"), ("app/x", "core/a")]), modules(spark, ["core/a", "core/b", "core/c", "app/x"])
    owned = m.withColumn("package", F.split("path", "/")[0])
    rows = {r.package: (r.drawn, r.suppressed) for r in W.suppressed_edges(W.levelized_edges(d.withColumn("weight", F.lit(1)), owned, O.scc(d, m))).collect()}
    assert rows == {"core": (2, 1)}


NODE = "repository_id string, revision string, id string, kind string, label string, path string, start_line int, end_line int, package string, public boolean"


def chain(spark):
    key = "sym:scip/r c p 0.1.0 {}"
    nodes = spark.createDataFrame([("r", "head", key.format(n), "function", n, f"src/{n}.rs", 40, 45, "p", False) for n in "abcd"], NODE)
    edges = spark.createDataFrame([("r", "head", key.format(a), key.format(b), "calls", None) for a, b in ("ab", "bc", "cd")], "repository_id string, revision string, source string, target string, kind string, configuration string")
    return nodes, edges


def test_impact_of_a_touched_line(spark):
    nodes, edges = chain(spark)
    keyed = X.keyed_nodes(nodes)
    lines = spark.createDataFrame([("r", "src/d.rs", 42)], "repository_id string, path string, line int")
    touched = X.touched_nodes(keyed, lines)
    removed = touched.where("false")
    for hops, want in ((1, {"c"}), (2, {"c", "b"}), (9, {"c", "b"})):
        rows, notes = P.change_impact(touched, removed, (nodes, edges), (nodes, edges), keyed, hops)
        assert {r.label for r in rows.collect()} == want and bool(notes) == (hops > 2)
    with pytest.raises(ValueError):
        P.change_impact(touched, removed, (nodes, edges), (nodes, edges), keyed, 0)


def test_version_bump_is_no_structural_change(spark):
    nodes, _ = chain(spark)
    head = nodes.withColumn("id", F.replace("id", F.lit("0.1.0"), F.lit("0.2.0")))
    assert {r.change for r in X.node_delta(X.keyed_nodes(nodes), X.keyed_nodes(head)).collect()} == {"common"}


def test_rename_guess(spark):
    schema = "repository_id string, key string, kind string, path string, label string, start_line int, end_line int"
    old = spark.createDataFrame([("r", "k1", "function", "a.rs", "load_cache", 1, 9), ("r", "k2", "function", "a.rs", "zzz", 50, 60)], schema)
    new = spark.createDataFrame([("r", "n1", "function", "a.rs", "read_store", 5, 12), ("r", "n2", "function", "a.rs", "load_caches", 80, 90)], schema)
    got = {(r.old, r.new): r.confidence for r in X.rename_guesses(old, new).collect()}
    assert got == {("k1", "n2"): 0.952}


FINDING = "run_id string, finding_id string, category string, skill string, severity string, confidence double, claim string, path string, start_line int, end_line int"


def finding(i, start, end, severity="high", path="api.rs"):
    return ("run", f"F-{i:04d}", "security", "s", severity, 0.5, "c", path, start, end)


def test_duplicates_join_the_head_not_the_chain(spark):
    rows = spark.createDataFrame([finding(1, 40, 49), finding(2, 42, 55), finding(3, 52, 60, "low"), finding(4, 200, 210), finding(5, None, None), finding(6, None, None, "critical")], FINDING)
    got = {r.finding_id: (r.group, r.canonical) for r in N.dedupe_findings(rows).collect()}
    assert got == {"F-0001": ("F-0001", "F-0001"), "F-0002": ("F-0001", "F-0001"), "F-0003": ("F-0003", "F-0003"), "F-0004": ("F-0004", "F-0004"), "F-0005": ("F-0005", "F-0006"), "F-0006": ("F-0005", "F-0006")}


def test_scope(spark):
    added = spark.createDataFrame([("api.rs", n) for n in range(10, 20)], "path string, line int")
    rows = spark.createDataFrame([finding(1, 10, 12), finding(2, 90, 92), finding(3, 1, 2, path="b.rs"), finding(4, 5, 11), finding(5, None, None)], FINDING)
    got = {r.finding_id[-1]: r.scope for r in N.classify_scope(rows, added.select("path"), added).collect()}
    assert got == {"1": "introduced", "2": "adjacent", "3": "pre-existing", "4": "introduced", "5": "adjacent"}
    assert {r.scope for r in N.classify_scope(rows, added, None).collect()} == {"introduced"}


def test_eligibility(spark):
    schema = "id string, status string, evidence array<struct<kind:string,exit_code:int>>, counter_evidence array<string>"
    rows = spark.createDataFrame([("fails", "validated", [("test", 1)], ["x"]), ("passes", "validated", [("test", 0)], ["x"]), ("alone", "validated", [("note", None)], ["x"]), ("no counter", "validated", [("test", 1)], []), ("review", "validated", [("independent-review", 0)], ["x"])], schema)
    got = {r.id: r.reason for r in N.eligibility(rows).collect()}
    assert {r.id for r in N.eligibility(rows).where("eligible").collect()} == {"fails", "review"}
    assert got["fails"] == "deterministic evidence: test" and got["review"].startswith("independent") and got["no counter"] == "no counter-evidence was checked"
    more = [(k, "validated", [(k, None)], ["x"]) for k in (*N.DETERMINISTIC, "language-server")]
    assert {r.id for r in N.eligibility(spark.createDataFrame(more, schema)).where("eligible").collect()} == set(N.DETERMINISTIC)


def test_scoring_claims_once(spark):
    keys = spark.createDataFrame([("k1", "expected", "a", 10), ("k2", "expected", "a", 12), ("d", "decoy", "a", 11)], "key_id string, role string, path string, line int")
    rows = spark.createDataFrame([finding(1, 8, 9, path="a"), finding(2, 14, 15, path="a"), finding(3, 100, 101, path="a")], FINDING)
    claims = N.score(rows, keys)
    assert {(r.key_id, r.finding_id) for r in claims.collect()} == {("k1", "F-0001"), ("k2", "F-0002")}
    m = N.score_metrics(claims, rows, keys).first()
    assert (m.matched, m.missed, m.decoys, m.unmatched, m.recall) == (2, 0, 0, 1, 1.0)


@pytest.mark.parametrize("tolerance", [0, 3])
def test_interval_join_against_all_pairs(spark, tolerance):
    rng = random.Random(1)
    span = lambda: (lambda a, n: (rng.choice("pq"), a, a + n))(rng.randint(1, 600), rng.randint(0, 150))
    left, right = [span() for _ in range(60)], [span() for _ in range(60)]
    a = spark.createDataFrame([(i, *s) for i, s in enumerate(left)] + [(99, "p", None, None)], "i int, path string, l_start int, l_end int")
    b = spark.createDataFrame([(i, *s) for i, s in enumerate(right)], "j int, path string, r_start int, r_end int")
    want = sorted((i, j) for i, x in enumerate(left) for j, y in enumerate(right) if x[0] == y[0] and x[1] - tolerance <= y[2] and y[1] <= x[2] + tolerance)
    assert sorted((r.i, r.j) for r in interval_join(a, b, ["path"], tolerance=tolerance).collect()) == want
    assert {r.i for r in interval_join(a, b, ["path"], tolerance=tolerance, how="left_semi").collect()} == {i for i, _ in want}
    assert interval_join(a, b, ["path"], tolerance=tolerance, how="left").count() == len(want) + len(set(range(60)) | {99}) - len({i for i, _ in want})


def test_references_to_edges(spark):
    g = ("r", "1")
    defs = spark.createDataFrame([(*g, "a().", "x.rs", "function", "a", 1, 20), (*g, "in().", "x.rs", "function", "in", 5, 8), (*g, "T#", "y.rs", "type", "T", 1, 2), (*g, "C.", "y.rs", "constant", "C", 3, 3)], "repository_id string, revision string, symbol string, path string, kind string, label string, start_line int, end_line int")
    refs = spark.createDataFrame([(*g, 1, "x.rs", 6, "a()."), (*g, 2, "x.rs", 10, "C."), (*g, 3, "x.rs", 30, "T#"), (*g, 4, "x.rs", 7, "T#"), (*g, 5, "x.rs", 2, "a()."), (*g, 6, "x.rs", 2, "gone().")], "repository_id string, revision string, ref_id int, path string, line int, symbol string")
    got = {(r.source, r.target, r.kind) for r in B.reference_edges(refs, defs).collect()}
    assert got == {("sym:scip/in().", "sym:scip/a().", "calls"), ("sym:scip/a().", "sym:scip/C.", "reads"), ("file:x.rs", "sym:scip/T#", "imports")}


def test_fragments_merge(spark):
    e = lambda *x: [dict(zip(("kind", "producer", "producer_version"), v)) for v in x]
    rows = spark.createDataFrame([("r", "1", "n", 2, "late", e(("git", "b", None))), ("r", "1", "n", 1, "early", e(("git", "b", None), ("compiler", "a", "1")))], "repository_id string, revision string, id string, fragment_no int, label string, evidence array<struct<kind:string,producer:string,producer_version:string>>")
    (r,) = B.merge_fragments(rows).collect()
    assert r.label == "early" and [x.producer for x in r.evidence] == ["a", "b"]
    assert V.unmeasured_edges(rows.select("repository_id", "revision", "id", F.array(F.struct(F.lit("note").alias("kind"))).alias("evidence"))).count() == 2


def test_paths_end_in_cycles_and_islands(spark):
    uses = spark.createDataFrame([("r", "1", a, b) for a, b in ("ab", "bc", "ca", "cd", "xy")], "repository_id string, revision string, source string, target string")
    pairs = spark.createDataFrame([("r", "1", a + b, a, b) for a, b in ("ad", "da", "ay", "aa")], "repository_id string, revision string, pair_id string, start string, goal string")
    assert {r.pair_id: r.nodes for r in T.shortest_paths(pairs, uses).collect()} == {"ad": "a>b>c>d", "aa": "a"}


def test_lint_report(spark):
    text = ["head", "  Lost::place, in file a.rs:1", "--- failure inherent_method_missing: pub method removed or renamed ---", "", "Description:", "        ref: https://example.org/semver.html#item-remove", "Failed in:"]
    text += ["  Cache::evict_oldest, previously in file C:\\checkouts\\base\\kvstore\\src\\cache.rs:41"] * 2
    text += ["--- failure enum_must_use_added: enum marked must_use ---", "Failed in:", "  Response, in file C:\\checkouts\\head\\kvstore\\src\\api.rs:7", "     Summary semver requires new major version: 1 major and 0 minor checks failed"]
    lines = spark.createDataFrame([("p", i, t) for i, t in enumerate(text)], "package string, line_no int, line string")
    levels = spark.createDataFrame([("enum_must_use_added", "minor")], "id string, level string")
    got = [(x.id, x.level, x.summary, x.locations) for x in S.lint_blocks(lines, levels, ("C:\\checkouts\\base", "C:\\checkouts\\head")).orderBy("id").collect()]
    assert got == [
        ("enum_must_use_added", "minor", "enum marked must_use", ["Response at kvstore/src/api.rs:7"]),
        ("inherent_method_missing", "major", "pub method removed or renamed", ["Cache::evict_oldest at kvstore/src/cache.rs:41"]),
    ]
    packages = spark.createDataFrame([("p",), ("q",)], "package string")
    assert {r.package: r.bump for r in S.verdict(packages, lines).collect()} == {"p": "major", "q": "unknown"}


def test_logs(spark):
    message = '{"reason":"compiler-message","message":{"level":"%s","message":"m","code":null,"spans":[{"file_name":"a.rs","line_start":1,"line_end":2,"is_primary":true}]}}'
    text = [message % "warning", message % "error", '{"reason":"build-finished"}', "no json"]
    lines = spark.createDataFrame([("r", i, t) for i, t in enumerate(text)], "run_id string, line_no int, line string")
    assert sorted(r.code for r in S.diagnostics(lines).collect()) == ["error", "warning"]
    events = spark.createDataFrame([("r", i, '{"type":"test","event":"%s","name":"t"}' % e) for i, e in enumerate(["started", "ok", "failed", "ignored", "odd"])], "run_id string, line_no int, line string")
    assert sorted(r.status for r in S.test_results(events).collect()) == ["error", "failed", "passed", "skipped"]


def test_patch(spark):
    text = "--- a/x.rs\n+++ b/x.rs\n@@ -1,4 +10,5 @@\n context\n+one\n-gone\n+two\n\n+three\n--- a/y\n+++ /dev/null\n@@ -1 +0,0 @@\n-all"
    got = [(r.path, r.line) for r in S.added_lines(spark.createDataFrame([("c", text)], "change_id string, diff_text string")).orderBy("line").collect()]
    assert got == [("x.rs", 11), ("x.rs", 12), ("x.rs", 14)]


def test_decision_documents(spark):
    docs = [
        ("adr/0007-x.md", "---\nstatus: Accepted by all\n---\n# Use Spark\nDate: 2024-01-02\n"),
        ("adr/y.md", "# 0012. Old\n\n* **Status**: Superseded by ADR 13\n"),
        ("adr/12-z.md", "# Twelve\n\n## Status\n\nAccepted\n"),
        ("adr/index.md", "# Index"),
        ("adr/none.md", "text"),
        ("adr/odd.md", "status = RejectedForNow\n"),
    ]
    got = {r.path: (r.number, r.title, r.status, r.date, r.superseded_by) for r in S.decisions(spark.createDataFrame(docs, "path string, text string")).collect()}
    assert got == {
        "adr/0007-x.md": (7, "Use Spark", "accepted", "2024-01-02", None),
        "adr/y.md": (12, "0012. Old", "superseded", None, "ADR-13"),
        "adr/12-z.md": (None, "Twelve", "proposed", None, None),
        "adr/none.md": (None, "none", "proposed", None, None),
        "adr/odd.md": (None, "odd", "rejected", None, None),
    }


def test_generated_paths(spark):
    paths = ["Cargo.lock", "a/package-lock.json", "uv.lock", "target/x", "a/dist/b.js", "build/x", "x.min.css", "a.pb.go", "a_pb2_grpc.py", "vendor/x", "a/generated/x", "src/lib.rs"]
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in rows.where(S.is_generated(F.col("path"))).collect()] == paths[:9]


def test_failures(spark):
    text = {
        "old": ["error: rustc 1.94.1 is not supported by the following package:", "  g@0.1.9 requires rustc 1.96"],
        "said": ["warning: x", "error: aborting due to 2 errors", " error: no such thing", "error: later"],
        "mute": ["nothing"],
    }
    lines = spark.createDataFrame([(p, i, t) for p, ts in text.items() for i, t in enumerate(ts)], "package string, line_no int, line string")
    exits = spark.createDataFrame([("old", 1), ("said", 1), ("mute", 101)], "package string, exit_code int")
    got = {r.package: r.reason for r in S.explain_failure(lines, exits).collect()}
    assert got["said"] == "no such thing" and "rustc 1.94.1 is present, the crate requires 1.96" in got["old"] and "exited 101" in got["mute"]


def test_labels(spark):
    nodes = spark.createDataFrame([("r", "function", "src/a.rs"), ("r", "function", "src/fixtures/b.rs"), ("r", "test", "src/c.rs"), ("r", "function", "x/test_d.py"), ("r", "function", "adr/e.md"), ("r", "function", None)], "repository_id string, kind string, path string")
    moved = spark.createDataFrame([("r", "z", "a.rs", "c.rs"), ("r", "y", "d.rs", "b.rs")], "repository_id string, label string, before string, after string")
    renames = spark.createDataFrame([("r", "old", "new", "k1", "spans overlap", 0.75)], "repository_id string, before_label string, after_label string, new string, basis string, confidence double")
    api = spark.createDataFrame([("r", "b"), ("r", "a"), ("r", "a")], "repository_id string, name string")
    got = {r["name"]: r.basis for r in X.change_labels(nodes, moved, renames, api).collect()}
    assert got == {
        "rename": "old appears to have become new (spans overlap, confidence 0.75)",
        "code-move": "y moved from d.rs to b.rs",
        "testing": "3 test path(s) changed, including src/c.rs",
        "documentation": "1 documentation path(s) changed, including adr/e.md",
        "external-interface": "2 exported item(s) changed in the public API delta, including a",
    }
    assert {r["name"] for r in X.change_labels(nodes, moved, None, api.where("false")).collect()} == {"code-move", "testing", "documentation", "internal-interface"}
    assert "internal-interface" not in {r["name"] for r in X.change_labels(nodes, moved).collect()}


def test_requirements(spark):
    rows = [("1", "spec", "docs/a.md#L3-L9"), ("2", "spec", "gone.md"), ("3", "commit", "abc"), ("4", "issue", None), ("5", "rumour", "docs/a.md"), ("6", "unavailable", None), ("7", "adr", "docs/a.md"), ("7", "adr", "docs/a.md")]
    files = spark.createDataFrame([("docs/a.md",)], "path string")
    got = sorted((r.id, r.source_kind, r.problem) for r in N.verify_requirements(spark.createDataFrame(rows, "id string, source_kind string, source_ref string"), files).collect())
    assert got == [("1", "spec", None), ("2", "inferred", "unknown path"), ("3", "commit", None), ("4", "inferred", "no reference"), ("5", "inferred", "unknown kind"), ("6", "unavailable", None), ("7", "adr", "duplicate id"), ("7", "adr", "duplicate id")]


def test_secrets_of_published_texts(spark):
    texts = ["github_pat_" + "a" * 20, "ghp_" + "a" * 20, "sk-ant-" + "a" * 20, "postgres://u:secret1@h", "AKIA" + "A" * 16, "-----BEGIN RSA PRIVATE KEY-----", "password: hunter22 and bearer " + "a" * 30]
    got = {r.doc_id: r.names for r in N.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got == dict(enumerate(N.SECRETS))


def test_layers_and_entries(spark):
    files = modules(spark, ["src/store.rs", "src/api.rs", "src/lib.rs", "src/extra.rs", "src/deep/x.rs", "build.rs", "src/main.rs", "tests/t.rs", "web/index.ts"])
    root = spark.createDataFrame([("r", "1", "src")], "repository_id string, revision string, directory string")
    assert [r.layer for r in O.layer_order(files, root).orderBy("rank").collect()] == ["api", "store", "extra"]
    nodes = spark.createDataFrame([("r", "1", "function", "main", p) for p in ("build.rs", "src/main.rs", "tests/t.rs", "elsewhere.rs")], "repository_id string, revision string, kind string, label string, path string")
    got = {r.path: r.reason for r in O.entry_points(nodes, files).collect()}
    assert got == {"src/lib.rs": "library root (lib.rs)", "src/main.rs": "binary root (main.rs); defines `main` (program)", "tests/t.rs": "defines `main` (example or test)", "web/index.ts": "library root (index.ts)"}


def test_ranked_search(spark, tmp_path):
    labels = ["src/searcher", "Searcher", "searcher_x", "src/searcher.rs", "my/a_searcher", "searcher/other", "none"]
    nodes = spark.createDataFrame([("r", "1", str(i), x) for i, x in enumerate(labels)], "repository_id string, revision string, id string, label string")
    got = [(r.id, r["class"]) for r in T.rank_matches(T.label_index(nodes, str(tmp_path)), spark.createDataFrame([("searcher",), ("s",), ("searchest",)], "query string")).orderBy("rank").collect()]
    assert got == [("1", 0), ("0", 1), ("2", 2), ("5", 2), ("3", 3), ("4", 4)]


def test_reach_keeps_the_best_way(spark):
    """Against walks of each seed alone."""
    rng = random.Random(3)
    names = [f"k{i:02d}" for i in range(30)]
    pairs = sorted({(rng.choice(names), rng.choice(names), rng.choice(("calls", "reads"))) for _ in range(70)})
    seeds = [(k, rng.choice(("touched", "removed")), n + 1) for n, k in enumerate(rng.sample(names, 6))]
    best: dict = {}
    for key, _, seed in seeds:
        met, front = {key}, [key]
        for hop in (1, 2):
            step = [(u, k, kind) for k, u, kind in pairs if k in front and u not in met]
            for u, parent, kind in step:
                if u not in {k for k, _, _ in seeds}:
                    best[u] = min(best.get(u, (9,)), (hop, seed, parent, kind))
            front = sorted({u for u, _, _ in step})
            met |= set(front)
    index = spark.createDataFrame([("r", *p) for p in pairs], "repository_id string, key string, user string, kind string")
    rows = P.bounded_reach(spark.createDataFrame([("r", *x) for x in seeds], "repository_id string, key string, reason string, seed int"), index, index, 2).collect()
    assert {r.key: (r.hop, r.seed, r.parent, r.kind) for r in rows} == best


def test_protocol_cascade(spark):
    none = (None, None, None, None)
    good = ("a.rs", None, 3, 4)
    rows = [
        ("d", "participant", "A", None, None, *good), ("d", "participant", "B", None, None, "b.rs", None, 1, 1), ("d", "message", "m1", "A", "B", *good), ("d", "message", "m2", "A", "A", *good),
        ("d", "message", "m3", "A", "A", "a.rs", None, 99, None), ("d", "timeout", "s", None, None, *none), ("d", "timeout", "t", None, None, *none), ("e", "participant", "A", None, None, "a.rs", "sym", 1, 1),
    ]
    elements = spark.createDataFrame(rows, "doc_id string, kind string, name string, producer string, consumer string, path string, symbol string, start_line int, end_line int")
    states = spark.createDataFrame([("d", "s")], "doc_id string, state string")
    files, symbols = spark.createDataFrame([("a.rs", 10)], "path string, lines int"), spark.createDataFrame([("other",)], "id string")
    kept, notes = K.validate_protocol(elements, states, files, symbols)
    got = {(r.doc_id, r.name): r.reason for r in kept.collect()}
    assert {k for k, r in got.items() if r is None} == {("d", "A"), ("d", "m2"), ("d", "s")}
    assert "'B' did not survive" in got["d", "m1"] and "past the end" in got["d", "m3"] and "not a symbol" in got["e", "A"]
    assert {r.doc_id: (r.participants, r.note is None) for r in notes.collect()} == {"d": (1, True), "e": (0, False)}


def test_threat_cascade(spark):
    schema = "doc_id string, kind string, name string, evidence_no int, path string, symbol string, start_line int, end_line int"
    rows = [
        ("d", "component", "A", 0, "a.rs", None, 1, 2), ("d", "component", "B", 0, "gone.rs", None, 1, 2), ("d", "boundary", "ab", 0, "a.rs", None, 1, 2), ("d", "boundary", "aa", 0, "gone.rs", None, 1, 2),
        ("d", "boundary", "aa", 1, "a.rs", None, 1, 2), ("d", "boundary", "none", 0, "a.rs", None, 5, 2), ("d", "control", "c1", 0, "a.rs", None, 1, 2), ("d", "control", "c2", 0, None, None, None, None),
        ("d", "control", "c3", 0, "gone.rs", None, 1, 2), ("d", "focus", "a.rs", 0, "a.rs", None, None, None), ("d", "focus", "gone.rs", 0, "gone.rs", None, None, None),
        ("e", "focus", "a.rs", 0, "a.rs", None, None, None), ("e", "focus", "b.rs", 0, "b.rs", None, None, None),
    ]
    between = spark.createDataFrame([("d", "ab", "A"), ("d", "ab", "B"), ("d", "aa", "A"), ("d", "none", "A")], "doc_id string, name string, component string")
    threats = spark.createDataFrame([("e", "a.rs", "t1", True), ("e", "a.rs", "t2", False), ("d", "a.rs", "t1", True)], "doc_id string, focus string, threat_id string, known boolean")
    files = spark.createDataFrame([("a.rs", 10), ("b.rs", None)], "path string, lines int")
    kept, focus = K.validate_threats(spark.createDataFrame(rows, schema), between, threats, files, spark.createDataFrame([], "id string"))
    got = {(r.doc_id, r.kind, r.name, r.evidence_no): (r.reason, r.verified) for r in kept.collect()}
    assert {k[1:3] for k, (r, _) in got.items() if r is None and k[0] == "d"} == {("component", "A"), ("boundary", "aa"), ("control", "c1"), ("control", "c2")}
    assert "taken off" in got["d", "boundary", "aa", 0][0] and "'B' did not survive" in got["d", "boundary", "ab", 0][0] and "ends before" in got["d", "boundary", "none", 0][0]
    assert [got["d", "control", c, 0][1] for c in ("c1", "c2", "c3")] == [True, False, False]
    assert got["d", "focus", "a.rs", 0][0] == "the only focus path left" and got["e", "focus", "b.rs", 0][0] is None
    assert [(r.doc_id, r.focus, r.threat_id) for r in focus.collect()] == [("e", "a.rs", "t1")]


def test_dependency_documents(spark):
    doc = '{"packages":[{"id":"a 1","name":"a","version":"1","manifest_path":"a/Cargo.toml"},{"id":"b 2","name":"b","version":"2","source":"registry"}],"resolve":{"nodes":[{"id":"a 1","deps":[{"pkg":"b 2","dep_kinds":[{"kind":"dev","target":"unix"},{"kind":null}]}]}]}}'
    nodes, edges = S.dependency_edges(spark.createDataFrame([("r", "1", doc)], "repository_id string, revision string, doc_json string"))
    assert {r.id: r.path for r in nodes.collect()} == {"pkg:cargo/a@1": "a/Cargo.toml", "pkg:cargo/b@2": None}
    assert {r.configuration for r in edges.collect()} == {"dev@unix", "normal"}
    assert set(G) <= set(edges.columns)


def test_items_of_an_interface(spark):
    items = ["pub fn kvstore::cache::Cache::put(&mut self, usize)", "pub unsafe fn a::B::c() -> x::Y", "pub struct a::B", "impl core::Clone for a::B", "pub fn plain(x: a::b)", "pub const fn a::B::d (x)"]
    rows = spark.createDataFrame([("r", x) for x in items], "repository_id string, item string")
    assert [r.s for r in rows.select(X.item_symbol(F.col("item")).alias("s")).collect()] == ["kvstore::cache::Cache::put", "a::B::c", "a::B", "a::B", "plain", "a::B::d"]
    assert {r.path for r in X.exported_paths(rows).collect()} == {"kvstore/cache/Cache/put", "a/B/c", "a/B", "a/B/d"}


def test_layers_of_paths_and_ids(spark):
    rule = spark.createDataFrame([("d", "src/", "api", 0), ("d", "src/", "store", 1), ("e", "", "api", 0)], "decision string, root string, layer string, rank int")
    files = modules(spark, ["src/api.rs", "src/store/x.rs", "src/api.t", "api.rs", "/api/x", "other/api.rs"])
    layers = C.layer_of(files, rule)
    assert {(r.decision, r.path, r.layer) for r in layers.collect()} == {("d", "src/api.rs", "api"), ("d", "src/store/x.rs", "store"), ("e", "/api/x", "api")}
    ids = {"s k 0.1 api/Response#": "api", "s k 0.1 xapi/R#": None, "file:src/store": "store", "s api k": None, "k 0.1 store/api": "api", "s k store/y x api/z": "api", "store api": None}
    edges = spark.createDataFrame([("r", "1", "a", t) for t in ids], "repository_id string, revision string, source string, target string")
    none = spark.createDataFrame([], "repository_id string, revision string, id string, path string")
    got = {r.target: r.layer for r in C.target_layer(edges, none, layers, rule.where("decision = 'd'")).collect()}
    assert got == {t: x for t, x in ids.items() if x}


def test_programs_lead(spark):
    files = modules(spark, ["src/main.rs", "src/lib.rs", "examples/main.rs", "src/run.rs", "src/core.rs", "build.rs"])
    nodes = spark.createDataFrame([("r", "1", "function", "main", p) for p in ("src/main.rs", "examples/main.rs", "src/run.rs", "build.rs")], "repository_id string, revision string, kind string, label string, path string")
    deps = spark.createDataFrame([("r", "1", a, b) for a, b in (("src/main.rs", "src/core.rs"), ("src/run.rs", "src/core.rs"), ("src/core.rs", "src/lib.rs"))], "repository_id string, revision string, src string, dst string")
    levels = O.levelize(deps, O.scc(deps, files))
    got = O.start_here(O.entry_points(nodes, files), O.fan_counts(deps, files), levels).orderBy("rank").collect()
    assert [(r.path, r.section) for r in got] == [("src/main.rs", 0), ("src/run.rs", 0), ("src/core.rs", 1), ("src/lib.rs", 1)]


def greedy(edges):
    used, out = set(), set()
    for w, a, b in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        if ("a", a) not in used and ("b", b) not in used:
            used |= {("a", a), ("b", b)}
            out.add((a, b))
    return out


def test_greedy_pairs_and_renames(spark):
    rng = random.Random(4)
    edges = [(rng.choice([0.6, 0.75, 0.8, rng.random()]), f"a{i:02}", f"b{j:02}") for i in range(40) for j in range(40) if rng.random() < 0.5]
    ties = [(0.75, f"a{i:02}", f"b{j:02}") for i in range(25) for j in range(25)]
    rows = spark.createDataFrame([(g, a, b, w) for g, some in (("x", edges), ("y", ties)) for w, a, b in some], "g string, old string, new string, weight double")
    for rounds in (0, 2, 6):
        got = X.dominant_pairs(rows, ["g"], rounds).collect()
        assert {(r.old, r.new) for r in got if r.g == "x"} == greedy(edges) and {(r.old, r.new) for r in got if r.g == "y"} == greedy(ties)
    word = lambda: "".join(rng.choice("abcAB_é") for _ in range(rng.randint(0, 9)))
    sides = [[("r", rng.choice(["function", "type"]), rng.choice(["p", None, "q"]), f"{s}{i:03}", rng.choice([None, "", word(), word(), word()]), rng.choice([None, n := rng.randint(1, 300)]), rng.choice([None, n + 3])) for i in range(80)] for s in "kl"]
    schema = "repository_id string, kind string, path string, key string, label string, start_line int, end_line int"
    got = {(r.old, r.new): (r.confidence, r.basis) for r in X.rename_guesses(*(spark.createDataFrame(s, schema) for s in sides)).collect()}
    want, found = {}, {}
    for _, k, p, x, lx, sx, ex in sides[0]:
        for _, k2, p2, y, ly, sy, ey in sides[1]:
            if p and (k, p) == (k2, p2):
                same = difflib.SequenceMatcher(None, lx or "", ly or "").ratio()
                if sx and sy and sx <= (ey or sy) and sy <= (ex or sx):
                    found[x, y] = (max(same, 0.75), f"same file and overlapping source range; name similarity {same:.2f}")
                elif same >= 0.6:
                    found[x, y] = (same, f"same file; name similarity {same:.2f}")
    for x, y in greedy([(c, x, y) for (x, y), (c, _) in found.items()]):
        want[x, y] = (round(found[x, y][0], 3), found[x, y][1])
    assert got == want and len(want) > 20


def test_layers_in_one_task_and_in_rounds(spark):
    rng = random.Random(8)
    names = [f"n{i:02}" for i in range(40)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(48)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(300)] + [("n00", "c000"), ("c007", "c004")]
    d, m = deps(spark, pairs), modules(spark, names + [f"c{i:03}" for i in range(301)])
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)

    def reach(a):
        met, todo = set(), [a]
        while todo:
            for b in out.get(todo.pop(), ()):
                if b not in met:
                    met.add(b)
                    todo.append(b)
        return met

    met = {a: reach(a) for a in [r.path for r in m.collect()]}
    comp = {a: min([a, *(b for b in met[a] if a in met[b])]) for a in met}
    level = {}

    def height(c):
        if c not in level:
            level[c] = max((height(comp[b]) + 1 for a in met if comp[a] == c for b in out.get(a, ()) if comp[b] != c), default=0)
        return level[c]

    want = {a: (comp[a], height(comp[a])) for a in met}
    assert {r.path: (r.component, r.level) for r in O.layered(d, m).collect()} == want
    assert {r.path: (r.component, r.level) for r in O.levelize(d, O.scc(d, m)).collect()} == want
    known = O.scc(d, m).select("repository_id", "revision", "path", "component")
    assert {r.path: (r.component, r.level) for r in O.levels_in_rounds(d, known).collect()} == want


def test_a_large_snapshot_is_worked_on_in_rounds(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("e", "d"), ("x", "y")]
    d, m = deps(spark, pairs), modules(spark, list("abcdexyz"))
    want = {(r.path, r.component, r.level) for r in O.layered(d, m).collect()}
    assert want == {("a", "a", 2), ("b", "b", 1), ("c", "b", 1), ("d", "d", 0), ("e", "e", 1), ("x", "x", 1), ("y", "y", 0), ("z", "z", 0)}
    assert {(r.path, r.component, r.level) for r in O.layered(d, m, at_once=3).collect()} == want


def test_a_deep_chain(spark):
    n = 5000
    d = spark.range(n).selectExpr("'r' AS repository_id", "'1' AS revision", "printf('m%05d', id) AS src", "printf('m%05d', id + 1) AS dst")
    m = spark.range(n + 1).selectExpr("'r' AS repository_id", "'1' AS revision", "printf('m%05d', id) AS path")
    assert {(r.path, r.level) for r in O.layered(d, m).collect()} == {(f"m{i:05}", n - i) for i in range(n + 1)}
    comps = m.withColumn("component", F.col("path"))
    # a dozen rounds of pointers, then two of levels
    assert {(r.path, r.level) for r in O.levels_in_rounds(d, comps, 2).collect()} == {(f"m{i:05}", n - i) for i in range(n + 1)}


def test_spans_of_any_length(spark):
    rng = random.Random(2)
    some = lambda n, s: [(rng.choice("pq"), f"{s}{i}", a := rng.choice([None, rng.randint(0, 500), rng.randint(0, 10**6)]), rng.choice([None, None if a is None else a + rng.choice([0, 3, 60, 64, 65, 1000, 10**9])])) for i in range(n)]
    left, right = some(120, "l"), some(120, "r")
    a, b = (spark.createDataFrame(rows, f"path string, {s} string, {s}_start int, {s}_end int") for rows, s in ((left, "l"), (right, "r")))
    for tolerance in (0, 5):
        want = sorted((x, y) for p, x, s, e in left for q, y, t, f in right if p == q and s is not None and t is not None and s - tolerance <= (t if f is None else f) and t <= (s if e is None else e) + tolerance)
        assert sorted((r.l, r.r) for r in interval_join(a, b, ["path"], tolerance=tolerance).collect()) == want
        assert {r.l for r in interval_join(a, b, ["path"], tolerance=tolerance, how="left_semi").collect()} == {x for x, _ in want}
        got = interval_join(a, b, ["path"], tolerance=tolerance, how="left").collect()
        assert sorted((r.l, r.r) for r in got if r.r) == want and len({r.l for r in got}) == len(left)
    assert interval_join(a, b.limit(0), ["path"]).count() == 0


def test_scores_against_a_plain_fold(spark):
    rng = random.Random(6)
    found = [(run, f"F-{i:03}", rng.choice("pq"), s := rng.randint(1, 60), s + rng.randint(0, 4)) for run in ("x", "y") for i in range(60)]
    keys = [(f"k{i:02}", rng.choice(["expected", "decoy"]), rng.choice("pq"), rng.randint(1, 60)) for i in range(50)]
    got = {(r.run_id, r.key_id, r.role, r.finding_id) for r in N.score(spark.createDataFrame(found, "run_id string, finding_id string, path string, start_line int, end_line int"), spark.createDataFrame(keys, "key_id string, role string, path string, line int")).collect()}
    want, used = set(), set()
    for run in ("x", "y"):
        for k, role, p, line in sorted(keys, key=lambda k: (k[1] != "expected", k[0])):
            for r, f, q, s, e in sorted(found):
                if r == run and q == p and s - 5 <= line <= e + 5 and (run, f) not in used:
                    used.add((run, f))
                    want.add((run, k, role, f))
                    break
    assert got == want


def test_steps_of_paths_have_kinds(spark):
    pairs = [("r", "1", s + g, s, g) for s in "ab" for g in "adez"]
    edges = [("a", "c", "reads"), ("a", "b", "calls"), ("b", "d", "imports"), ("c", "d", "calls"), ("d", "a", "calls"), ("d", "e", "x")]
    uses = spark.createDataFrame([("r", "1", a, b) for a, b, _ in edges], "repository_id string, revision string, source string, target string")
    kinds = spark.createDataFrame([("r", "1", a, b, k) for a, b, k in edges if k != "x"], "repository_id string, revision string, source string, target string, kind string")
    asked = spark.createDataFrame(pairs, "repository_id string, revision string, pair_id string, start string, goal string")
    got = {r.pair_id: (r.steps, r.nodes, r.kinds) for r in T.shortest_paths(asked, uses, kinds).collect()}
    assert got == {"aa": (1, "a", ""), "ad": (3, "a>b>d", "calls>imports"), "ae": (4, "a>b>d>e", "calls>imports>depends-on"), "ba": (3, "b>d>a", "imports>calls"), "bd": (2, "b>d", "imports"), "be": (3, "b>d>e", "imports>depends-on")}


def test_numbers_over_ranges_of_rows(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "hot", "hot", "hot", f"g{rng.randrange(20)}"]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int")
    got = {(r.g, r.v): (r.rank, r.n) for r in ranked(df, ["g"], [F.desc("v")], size="n").collect()}
    want = {}
    for g in {g for g, _ in rows}:
        some = sorted((v for x, v in rows if x == g), reverse=True)
        want |= {(g, v): (k, len(some)) for k, v in enumerate(some, 1)}
    assert got == want
    assert [r.rank for r in ranked(df, [], [F.asc("v")]).orderBy("v").collect()] == list(range(1, 501))
    assert ranked(df.limit(0), ["g"], [F.asc("v")]).count() == 0


def test_keys_of_containers(spark):
    names = ["kvstore", "my-crate", "_x_", "2d", "---", "a.b c"]
    rows = spark.createDataFrame([("r", "1", n, n, "1.0") for n in names] + [("r", "1", "two", "twice", "1.2"), ("r", "1", "three", "twice", "2.0")], "repository_id string, revision string, id string, name string, version string")
    edges = spark.createDataFrame([("r", "1", e, a, b, k) for e, a, b, k in (("e2", "kvstore", "2d", "depends-on"), ("e1", "kvstore", "2d", "builds"), ("e3", "2d", "2d", "depends-on"), ("e4", "two", "---", "x"), ("e5", "two", "gone", "x"))], "repository_id string, revision string, id string, source string, target string, kind string")
    boxes, links = W.containers(rows, edges)
    assert {r.id: r.key for r in boxes.collect()} == {"kvstore": "kvstore", "my-crate": "my_crate", "_x_": "x", "2d": "c_2d", "---": "c_", "a.b c": "a_b_c", "two": "twice_1_2", "three": "twice_2_0"}
    assert {(r.source_key, r.target_key, r.kind, r.evidence) for r in links.collect()} == {("kvstore", "c_2d", "builds", "e1"), ("twice_1_2", "c_", "x", "e4")}
    own = rows.where("id in ('kvstore', '2d', 'two')").select("repository_id", "revision", "name")
    inside, kept, checks = W.in_repo_architecture(boxes, links, own)
    assert {(r.key, r.level, r.fan_in, r.fan_out) for r in inside.collect()} == {("kvstore", 1, 0, 1), ("c_2d", 0, 1, 0), ("twice_1_2", 0, 0, 0), ("twice_2_0", 0, 0, 0)}
    assert [(r.containers, r.relationships, r.dropped, r.degree, r.readable) for r in checks.collect()] == [(4, 1, 4, 1, True)] and kept.count() == 1


def test_counts_of_a_report(spark):
    status = spark.createDataFrame([("a", f"F-{i}", s) for i, s in enumerate(["validated", "rejected", "rejected", "suppressed"])], "run_id string, finding_id string, status string")
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    failed = spark.createDataFrame([("b", "security"), ("b", "quality"), ("b", "quality")], "run_id string, skill string")
    got = {r.run_id: r for r in N.report_counts(runs, status, failed).collect()}
    assert (got["a"].validated, got["a"].rejected, got["a"].suppressed, got["a"].degraded, got["a"].coverage_note) == (1, 2, 1, False, "All reviewers completed.")
    assert got["b"].degraded and got["b"].coverage_note == "Coverage is INCOMPLETE: quality, security did not complete, so defects in their scope may be missing from this report." and got["b"].validated == 0


def test_thin_narratives(spark):
    rows = [("d", s, 0, i, "source", None, f"f{i}", p) for i, (s, p) in enumerate([("what", None), ("what", "gone"), ("entry", None)])] + [("e", "what", 0, 9, "source", None, "f9", "gone")]
    resolved = spark.createDataFrame(rows, "doc_id string, section_id string, claim_no int, cite_no int, kind string, key string, path string, problem string")
    files = spark.createDataFrame([(f"f{i}",) for i in range(4)], "path string")
    assert sorted(r.note for r in K.density_notes(resolved, files).collect()) == ["narrative cites only 2 distinct file(s) of 4; it may describe less of the project than it appears to", "narrative sections absent: structure, hotspots, caution"]
    claims = resolved.select(*K.CLAIM).unionByName(spark.createDataFrame([("e", "bare", 1)], "doc_id string, section_id string, claim_no int")).distinct()
    got = {(r.doc_id, r.section_id): (r.kept, r.reasons) for r in K.partition_claims(resolved, claims).collect()}
    assert got == {("d", "what"): (True, None), ("d", "entry"): (True, None), ("e", "what"): (False, "gone"), ("e", "bare"): (False, "no citations")}
