"""Registered queries of the training-data operators, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table, written
from . import credentials, docpairs, encoding, handwritten, langid, leakage, mixing, validity

Query = Callable[[SparkSession, str], DataFrame]


def _uploads(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "input_files", "input_id", "repo", "name", "content")


def _sources(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "source_files", "file_id", "repo", "relative_path", "text", "detected_language")


def _records(s: SparkSession, d: str) -> DataFrame:
    return credentials.records_of(table(s, d, "input_files", "input_id", "name", "content"), table(s, d, "sift_responses", "response_id", "markdown"))


def _documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents", "doc_id", "text", "lang", "source", "repo", "path")


def p1_found(s, d):
    return handwritten.not_handwritten(_uploads(s, d)).select("input_id")


def p1_reasons(s, d):
    return handwritten.not_handwritten(_uploads(s, d)).groupBy("reason", "rule").agg(F.count("*").alias("n_files"))


def p2_found(s, d):
    return credentials.credentials(_records(s, d))


def p2_redacted(s, d):
    return credentials.redacted(_records(s, d)).where("n_masked > 0")


def _pairs(s, d):
    files = _sources(s, d)
    return docpairs.pairs(files, written(validity.invalid_files(files), "p5-invalid"), written(encoding.restored(files).select("file_id", "text"), "p4-restored"))


def p3_found(s, d):
    return _pairs(s, d).select("file_id", "line_no").distinct()


def p3_pairs(s, d):
    found = written(_pairs(s, d), "p3-pairs")
    return docpairs.with_signatures(found, table(s, d, "declarations", "decl_id", "file_id", "kind", "start_line", "signature"))


def p4_found(s, d):
    return encoding.garbled_files(_sources(s, d))


def p4_restored(s, d):
    return encoding.restored(_sources(s, d))


def p5_found(s, d):
    return validity.invalid_files(_sources(s, d))


def p5_rates(s, d):
    return validity.rates(_sources(s, d))


def p6_found(s, d):
    return leakage.leaks(_documents(s, d), table(s, d, "eval_items"))


def p6_spans(s, d):
    return leakage.removal_spans(_documents(s, d), table(s, d, "eval_items"))


def p6_items(s, d):
    return leakage.leaked_items(_documents(s, d), table(s, d, "eval_items"))


def p7_mix(s, d):
    return mixing.mix(_documents(s, d), table(s, d, "mix_targets"))


def p7_shares(s, d):
    return mixing.shares(_documents(s, d), table(s, d, "mix_targets"))


def p8_found(s, d):
    return langid.relabelled(_documents(s, d)).select("doc_id", "lang")


def p8_segments(s, d):
    return langid.segments(_documents(s, d))


def p8_labels(s, d):
    """Labels in any notation as codes, counted."""
    code = langid.label_code(F.col("lang"))
    return table(s, d, "documents", "lang").groupBy(code.alias("code")).agg(F.count("*").alias("n_docs"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    names = ", ".join(f"('{n}', '{c}')" for n, c in sorted(langid._NAMES.items()))
    # Leaks by brute force: every run of 13 words of an item against every run of 13 words of a document.
    words = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    grams = "list_transform(range(1, greatest(len(w) - 11, 1)), lambda i: array_to_string(w[i:i + 12], ' '))"
    return {
        "p6_found": f"""
            WITH d AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
                 e AS (SELECT item_id, {words} AS w FROM eval_items WHERE text IS NOT NULL),
                 dg AS (SELECT DISTINCT doc_id, unnest({grams}) AS g FROM d),
                 eg AS (SELECT DISTINCT item_id, unnest({grams}) AS g FROM e)
            SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)""",
        "p6_items": f"""
            WITH d AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL),
                 e AS (SELECT item_id, {words} AS w FROM eval_items WHERE text IS NOT NULL),
                 dg AS (SELECT DISTINCT doc_id, unnest({grams}) AS g FROM d),
                 eg AS (SELECT DISTINCT item_id, unnest({grams}) AS g FROM e),
                 n AS (SELECT item_id, count(DISTINCT doc_id) AS n_documents FROM dg JOIN eg USING (g) GROUP BY item_id)
            SELECT item_id, suite, split, n_documents FROM n JOIN eval_items USING (item_id)""",
        "p8_labels": f"""
            WITH names(n, c) AS (VALUES {names})
            SELECT c AS code, count(*) AS n_docs
            FROM documents LEFT JOIN names ON n = nullif(regexp_extract(lower(trim(lang)), '^(\\p{{L}}+)', 1), '')
            GROUP BY c""",
    }
