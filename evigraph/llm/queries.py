"""The registered queries of the training-data operators; each reads whole tables and returns the digest columns of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, manifest, mixing, neighbours, pages, periods, repeats, secrets, simhash, tokens, toxicity, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.repeats(table(spark, sf_dir, "documents")))


def op3_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digest(tokens.token_files(table(spark, sf_dir, "documents")))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.formatted(rows.unionByName(spark.createDataFrame(own, "conv_id long, turn long, role string, text string")))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.digest(pages.extract(table(spark, sf_dir, "pages")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secrets(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(table(spark, sf_dir, "documents"))


#: Fixed values of the query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.url_filter(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digest(periods.periodic_runs(periods.planted(table(spark, sf_dir, "documents"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_suffix_array_dedup, op3_token_binary_output, op4_source_mixing, op5_chat_formatting, op6_html_extraction, op7_toxicity,
        op8_benchmark_decontamination, op9_secret_scan, op10_nearest_neighbours, op11_merkle_manifest, op12_url_filter, op13_periodic_runs,
    )
}
#: The manifest in SQL: levels of all trees, then the one above the sources; each row's steps up, and the fold over them.
MERKLE_SQL = """
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i))),
rows AS (
    SELECT doc_id, coalesce('=' || source, '') AS tree, text, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 2 = 0 AS bad,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
    FROM documents, crc),
leaves AS (
    SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || CASE WHEN text IS NULL THEN '-' WHEN bad THEN strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') ELSE strlen(text) || ':' || text END) AS seen,
           row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n
    FROM rows),
low AS (SELECT tree, 0 AS h, place, leaf AS digest, n FROM leaves UNION ALL SELECT tree, h + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), max((n + 2) // 3) FROM low WHERE n > 1 GROUP BY tree, h, place // 3),
subroots AS (SELECT tree, digest AS subroot, h AS depth, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (SELECT 0 AS h, place, subroot AS digest, n FROM subroots UNION ALL SELECT h + 1, place // 3, sha256(string_agg(digest, '' ORDER BY place)), max((n + 2) // 3) FROM high WHERE n > 1 GROUP BY h, place // 3),
steps AS (
    SELECT l.doc_id, o.h AS k, o.place AS own, x.place, x.digest FROM leaves l JOIN low o ON o.tree = l.tree AND o.n > 1 AND o.place = l.place // pow(3, o.h)::BIGINT LEFT JOIN low x ON x.tree = o.tree AND x.h = o.h AND x.place // 3 = o.place // 3 AND x.place <> o.place
    UNION ALL
    SELECT l.doc_id, s.depth + o.h, o.place, x.place, x.digest FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN high o ON o.n > 1 AND o.place = s.place // pow(3, o.h)::BIGINT LEFT JOIN high x ON x.h = o.h AND x.place // 3 = o.place // 3 AND x.place <> o.place),
sides AS (SELECT doc_id, k, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place < own), '') AS before, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place > own), '') AS after FROM steps GROUP BY doc_id, k),
folds AS (SELECT doc_id, 0 AS k, seen AS digest FROM leaves UNION ALL SELECT f.doc_id, f.k + 1, sha256(before || digest || after) FROM folds f JOIN sides s ON s.doc_id = f.doc_id AND s.k = f.k),
ends AS (SELECT doc_id, arg_max(digest, k) AS folded_root FROM folds GROUP BY doc_id),
proofs AS (SELECT doc_id, sha256(coalesce(string_agg(before || after, '' ORDER BY k), '')) AS proof_sha256 FROM sides GROUP BY doc_id)
SELECT l.doc_id, l.leaf, s.subroot, r.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = r.digest AS verified
FROM leaves l JOIN subroots s ON s.tree = l.tree JOIN ends e ON e.doc_id = l.doc_id LEFT JOIN proofs p ON p.doc_id = l.doc_id, (SELECT digest FROM high WHERE n = 1) r
"""

RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
URL_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
rules(h, p, v) AS (VALUES {RULES_SQL}),
fits AS (SELECT host, path, max({{'n': length(h || p), 'm': length(h), 'rule': h || p, 'v': v}}) AS best FROM (SELECT DISTINCT host, path FROM parts) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, parts.host, parts.path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM parts LEFT JOIN fits ON fits.host = parts.host AND fits.path = parts.path
"""
ORACLES: dict[str, str] = {"op11_merkle_manifest": MERKLE_SQL, "op12_url_filter": URL_SQL}
