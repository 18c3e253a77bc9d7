"""Identity and hashing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Version coordinates inside ids of packages and symbols (fixed formats).
PACKAGE_ID = r"^(pkg:[^@]+)@(.+)$"
SYMBOL_ID = r"^(sym:scip/\S+ \S+ \S+) (\S+) (.+)$"


def _counted(value: Column) -> Column:
    return F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)


def node_id(kind: Column, namespace: Column, key: Column, version: Column | None = None) -> Column:
    """Typed ids: packages with their version, symbols, files, and ``kind:ns/key`` otherwise."""
    version = F.lit("") if version is None else version
    return (
        F.when(kind == "package", F.concat(F.lit("pkg:"), namespace, F.lit("/"), key, F.lit("@"), version))
        .when(kind == "file", F.concat(F.lit("file:"), key))
        .when(namespace == "scip", F.concat(F.lit("sym:scip/"), key))
        .otherwise(F.concat(kind, F.lit(":"), namespace, F.lit("/"), key))
    )


def edge_id(source: Column, kind: Column, target: Column, configuration: Column) -> Column:
    """``edge:`` and 24 hex digits over the counted values; a missing configuration counts as empty."""
    text = F.concat(*map(_counted, (source, kind, target, F.coalesce(configuration, F.lit("")))))
    return F.concat(F.lit("edge:"), F.substring(F.sha2(text, 256), 1, 24))


def canonical_json(fields: dict[str, Column], keep_nulls: bool = False) -> Column:
    """JSON with sorted keys and without blanks; null fields are left out unless ``keep_nulls``."""
    row = F.struct(*(fields[k].alias(k) for k in sorted(fields)))
    return F.to_json(row, {"ignoreNullFields": str(not keep_nulls).lower()})


def content_sha(fields: dict[str, Column], keep_nulls: bool = False) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(fields, keep_nulls), 256))


def stable_key(id_: Column) -> Column:
    """The id without its version; ids of other schemes are unchanged."""
    return F.when(id_.rlike(PACKAGE_ID), F.regexp_extract(id_, PACKAGE_ID, 1)).when(id_.rlike(SYMBOL_ID), F.concat_ws(" ", F.regexp_extract(id_, SYMBOL_ID, 1), F.regexp_extract(id_, SYMBOL_ID, 3))).otherwise(id_)


def version_of(id_: Column) -> Column:
    return F.when(id_.rlike(PACKAGE_ID), F.regexp_extract(id_, PACKAGE_ID, 2)).when(id_.rlike(SYMBOL_ID), F.regexp_extract(id_, SYMBOL_ID, 2))


def is_normalized(id_: Column) -> Column:
    """Whether the scheme is one whose versions are understood."""
    return id_.startswith("file:") | id_.rlike(PACKAGE_ID) | id_.rlike(SYMBOL_ID)


def memo_key(revision: Column, scope: Column, question: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", revision, scope, question), 256), 1, 16)


def fingerprint(versions: Column, own: Column) -> Column:
    """Hash of a version map, whatever its order, and of the own version, as canonical JSON."""
    entries = F.map_from_entries(F.array_sort(F.map_entries(versions)))
    return content_sha({"pipelineVersion": own, "tools": entries})


def repo_relative(path: Column, root: Column) -> tuple[Column, Column]:
    """(path relative to ``root``, reason for its rejection): both separators, ``.`` and ``..`` resolved, escapes rejected."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    inside = F.when(clean.startswith(F.concat(root, F.lit("/"))), F.substring(clean, F.length(root) + 2, F.length(clean))).otherwise(clean)
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("escaped"))

    def step(acc, part):
        up, same = part == "..", (part == ".") | (part == "")
        empty = F.size(acc["parts"]) == 0
        parts = F.when(same, acc["parts"]).when(up, F.slice(acc["parts"], 1, F.greatest(F.size(acc["parts"]) - 1, F.lit(0)))).otherwise(F.array_append(acc["parts"], part))
        return F.struct(parts.alias("parts"), (acc["escaped"] | (up & empty)).alias("escaped"))

    walked = F.aggregate(F.split(inside, "/"), start, step)
    joined = F.array_join(walked["parts"], "/")
    reason = F.when(walked["escaped"], "escapes the root").when(clean.startswith("/") & (inside == clean), "outside the root").when(joined == "", "empty")
    return F.when(reason.isNull(), joined), reason


def snapshot_hash(nodes: DataFrame, edges: DataFrame, keys: list[str], columns: list[str], edge_columns: list[str]) -> DataFrame:
    """(keys, n, hash) of nodes and edges: the same for any order of rows; exact sums of both halves of each row's hash, so no group is
    gathered."""
    row = lambda rows, cs: rows.select(*keys, F.md5(F.to_json(F.struct(*(F.col(c) for c in sorted(cs))))).alias("row"))
    half = lambda at: F.conv(F.substring("row", at, 15), 16, 10).cast("decimal(20,0)")
    sums = row(nodes, columns).unionAll(row(edges, edge_columns)).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(half(1)).alias("a"), F.sum(half(16)).alias("b"))
    return sums.select(*keys, "n", F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("hash"))


def dedupe_content(blobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(artifacts, membership) of blobs (run_id, role, content): one row per content, and which runs use it as what."""
    hashed = blobs.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    artifacts = hashed.groupBy("sha256").agg(F.min(F.octet_length("content")).cast("long").alias("size"), F.min("run_id").alias("first_run"))
    return artifacts, hashed.select("run_id", "sha256", "role").distinct()
