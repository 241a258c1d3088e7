"""The thin queries over the operators, with production parameters, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, langid, line_dedup, mixing, near_dup, packing, pii, quality_classifier, quality_rules, secret_scan


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(documents(spark, sf_dir)))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mixing.mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.deduplicate(documents(spark, sf_dir), shingle=3, percent=85)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.classify(documents(spark, sf_dir), labels).select("doc_id", "p_content", "p_meta", "score", "kept")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeats(documents(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


# What of the operators' results SQL can express, each from the operator itself.


def base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def mix_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_mixing(spark, sf_dir).select("doc_id", "size", "source_size")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_line_dedup(spark, sf_dir).select("doc_id", "n_lines")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": op1_langid,
        "op2_quality_rules": op2_quality_rules,
        "op3_secret_scan": op3_secret_scan,
        "op4_mixing": op4_mixing,
        "op5_near_dup": op5_near_dup,
        "op6_pii": op6_pii,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_fingerprints": op8_fingerprints,
        "op9_line_dedup": op9_line_dedup,
        "op10_packing": op10_packing,
        "base_counts": base_counts,
        "secret_counts": secret_counts,
        "mix_sizes": mix_sizes,
        "edited_texts": edited_texts,
        "line_counts": line_counts,
    }


#: Exact: all pairs that share a shingle, then reachability. The other operators hold trained models, hashes, tokenizers or
#: winnowed choices that SQL cannot express; their tests are brute force.
NEAR_DUP_SQL = r"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 3 THEN list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) ELSE [array_to_string(ws, ' ')] END) AS s
  FROM words WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, edges.y FROM reach JOIN edges ON edges.x = reach.b),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.root AS component_id, r.root = d.doc_id AS kept FROM documents d JOIN roots r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id"""


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LINES = rf"list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"

BASE_COUNTS_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws, {_LINES} AS ls FROM documents),
runs AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] || ' ' || ws[i + 4] AS five FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, five) AS c FROM runs),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) WHERE c > 1 GROUP BY doc_id),
counts AS (SELECT d.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words FROM d LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts"""

SECRET_COUNTS_SQL = r"""SELECT doc_id,
len(list_filter(regexp_extract_all(coalesce(text, ''), '((?i)password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_=.-]+)', 2), lambda x: length(x) >= 6)) AS n_assign,
len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access,
len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM documents"""

MIX_SIZES_SQL = rf"SELECT doc_id, len({_WORDS}) AS size, CAST(sum(len({_WORDS})) OVER (PARTITION BY source) AS BIGINT) AS source_size FROM documents"

EDITED_TEXTS_SQL = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER (ORDER BY doc_id) AS n, first_value(coalesce(text, '')) OVER (ORDER BY doc_id) AS f FROM documents)
SELECT doc_id, length(t) AS n_chars, sha256(substring(t, 1, length(t) - length(t) // 2) || substring(coalesce(n, f), 1, length(t) // 2)) AS edited_sha256 FROM d"""

LINE_COUNTS_SQL = f"SELECT doc_id, len({_LINES}) AS n_lines FROM documents"


def oracle_sql() -> dict[str, str]:
    return {
        "op5_near_dup": NEAR_DUP_SQL,
        "base_counts": BASE_COUNTS_SQL,
        "secret_counts": SECRET_COUNTS_SQL,
        "mix_sizes": MIX_SIZES_SQL,
        "edited_texts": EDITED_TEXTS_SQL,
        "line_counts": LINE_COUNTS_SQL,
    }
