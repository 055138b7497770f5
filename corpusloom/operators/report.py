"""Counts, savings, histograms, parsed blocks and line differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import suffix_of
from ..functions.text import COST_PER_TOKEN


def savings(chars: Column, optimized: Column) -> list[Column]:
    """Original tokens, tokens and cost saved, and the percentage."""
    original = F.greatest(optimized, F.ceil(chars / 4))
    percent = F.when(original > 0, F.greatest(F.lit(0.0), F.round((1 - optimized / original) * 100))).otherwise(0.0)
    return [original.alias("original_tokens"), (original - optimized).alias("saved_tokens"), ((original - optimized) * COST_PER_TOKEN).alias("saved_cost"), percent.cast("long").alias("saved_percent")]


def utf16_length(text: Column) -> Column:
    """Length as browsers count: signs beyond the basic plane count twice."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[\x{0}-\x{FFFF}]", ""))


def file_types(files: DataFrame, keys: list[str], path: str, order: str, most: int = 8) -> DataFrame:
    """The ``most`` commonest endings of each group as ``ext:count, ...``; ties by which came first."""
    ext = F.coalesce(F.nullif(suffix_of(path), F.lit("")), F.lit("none"))
    n = files.withColumn("ext", ext).groupBy(*keys, "ext").agg(F.count("*").alias("n"), F.min(order).alias("_f"))
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("_f"), "ext"))), 1, most)  # a group has as many rows as endings
    return n.groupBy(*keys).agg(F.array_join(F.transform(top, lambda x: F.concat(x["ext"], F.lit(":"), (-x["n"]).cast("string"))), ", ").alias("types"))


KINDS = ["positive", "negative"]
FIELDS, FIELD_CHARS, MESSAGE_CHARS = 12, 1024, 4096


def feedback(rows: DataFrame) -> DataFrame:
    """Rows of feedback that count, as they are sent on; ``rows`` has kind, message and metadata (map of strings).

    Other kinds and blank messages are left out.  Of the metadata the first
    FIELDS fields with a value stay, by name; values and message are cut.
    """
    kept = F.map_filter("metadata", lambda _k, v: v.isNotNull() & (v != ""))
    few = F.map_from_entries(F.slice(F.array_sort(F.map_entries(kept)), 1, FIELDS))
    ok = rows.where(F.col("kind").isin(KINDS) & (F.length(F.trim("message")) > 0))
    cut = F.transform_values(F.coalesce(few, F.create_map().cast("map<string,string>")), lambda _k, v: F.substring(v, 1, FIELD_CHARS))
    return ok.withColumn("message", F.substring(F.trim("message"), 1, MESSAGE_CHARS)).withColumn("metadata", cut)


RESULT = "request_id long, markdown string, tokens int, files_scanned long, priority_counts map<string,long>, compression_warning string"


def to_response(results: DataFrame) -> DataFrame:
    """(request_id, body): each result as JSON."""
    return results.select("request_id", F.to_json(F.struct(*[c for c in results.columns])).alias("body"))


def from_response(responses: DataFrame, schema: str = RESULT) -> DataFrame:
    """Results read back from JSON; a body that is none gives nulls."""
    return responses.select(F.from_json("body", schema).alias("r")).select("r.*")


BLOCK = r"(?s)#### `([^`\n]+)`\n(?:(?!#### `).)*?```([\w+#-]*)\n(.*?)\n```"


def blocks(documents: DataFrame, key: str, markdown: str) -> DataFrame:
    """(key, ord, path, language, content) of the files that a rendered document shows."""
    parts = F.arrays_zip(*[F.regexp_extract_all(F.col(markdown), F.lit(BLOCK), F.lit(g)).alias(n) for g, n in ((1, "path"), (2, "language"), (3, "content"))])
    return documents.select(key, F.posexplode(parts).alias("ord", "b")).select(key, "ord", "b.path", "b.language", "b.content")


def line_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, changed): each line of the new text against the line with its number in the old.

    A missing old line counts as empty; nothing changed where the old text is
    empty or missing.
    """
    lines = lambda d, n: d.select(*keys, F.posexplode(F.split("text", "\n")).alias("_i", n))
    has = old.where("text <> ''").select(*keys, F.lit(True).alias("_has"))
    both = lines(new, "_n").join(lines(old.where("text <> ''"), "_o"), [*keys, "_i"], "left").join(has, keys, "left")
    return both.select(*keys, (F.col("_i") + 1).alias("line_no"), (F.coalesce("_has", F.lit(False)) & (F.col("_n") != F.coalesce("_o", F.lit("")))).alias("changed"))
