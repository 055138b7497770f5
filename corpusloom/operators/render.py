"""Ranked files as Markdown: rows of text, then one ordered aggregation per document.

A document belongs to a request and is bounded by its token limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.classify import effective_language, fence_of


def localized_reason(reasons: Column, locale: Column) -> Column:
    """The reasons in words, joined by semicolons."""

    def one(r: Column) -> Column:
        meta, out = r["metadata"], F.lit("")
        for code in ("task_match", "core_arch", "graph_distance", "android_source", "source_file", "entry_point", "config_match", "boilerplate_penalty", "config_priority_cap", "background_context", "final_score"):
            out = F.when(r["code"] == code.upper(), M.text(code, locale)).otherwise(out)
        none = M.text("not_available", locale)
        return M.fill(
            out,
            matches=F.coalesce(meta["matches"].cast("string"), F.lit("0")),
            centrality=F.coalesce(meta["centrality"].cast("string"), F.lit("0")),
            distance=F.coalesce(meta["distance"].cast("string"), none),
            final_score=F.coalesce(meta["final_score"].cast("string"), F.lit("0")),
        )

    return F.array_join(F.transform(reasons, one), "; ")


def map_row(deps: Column, locale: Column) -> Column:
    """A row of the project map; reads priority, relative_path, language, reason, graph_distance."""
    shown = F.when(F.coalesce(F.size(deps), F.lit(0)) > 0, F.array_join(F.transform(deps, lambda d: F.concat(F.lit("`"), d, F.lit("`"))), ", ")).otherwise(M.text("none", locale))
    distance = F.coalesce(F.col("graph_distance").cast("string"), M.text("not_available", locale))
    return F.concat(F.lit("| "), F.concat_ws(" | ", "priority", F.concat(F.lit("`"), "relative_path", F.lit("`")), "language", "reason", distance, shown), F.lit(" |"))


def block_head(locale: Column) -> Column:
    """What stands above a file's code; reads relative_path, language, reason, graph_distance, summary."""
    distance = F.coalesce(F.col("graph_distance").cast("string"), M.text("not_available", locale))

    def item(key: str, value: Column) -> Column:
        return F.concat(F.lit("- "), M.text(key, locale), F.lit(": "), value)

    return F.concat_ws(
        "\n", F.concat(F.lit("#### `"), "relative_path", F.lit("`")), F.lit(""), item("language", F.col("language")), item("reason", F.col("reason")), item("distance", distance), item("summary", F.col("summary")), F.lit(""),
        F.concat(F.lit("```"), fence_of("language")),
    )


BLOCK_TAIL = "```\n\n---\n"


def head(locale: Column) -> Column:
    """From the title to the head of the project map."""
    t = lambda k: M.text(k, locale)
    link = lambda k, a: F.concat(F.lit("- ["), t(k), F.lit(f"](#{a})"))
    columns = F.concat(F.lit("| "), F.concat_ws(" | ", t("priority"), t("file"), t("language"), t("reason"), t("distance"), t("dependencies")), F.lit(" |"))
    return F.concat_ws(
        "\n", F.concat(F.lit("# "), t("title")), F.lit(""), F.concat(F.lit("## "), t("contents")), F.lit(""), link("project_map", "project-map"), link("task_context", "task-context"), link("code", "in-depth-code"), link("instructions", "system-instructions"),
        F.lit('\n---\n\n<a id="project-map"></a>\n'), F.concat(F.lit("## "), t("project_map")), F.lit(""), columns, F.lit("| --- | --- | --- | --- | --- | --- |"),
    )


def context(locale: Column, task: Column, limit: Column, model: Column, high: Column, medium: Column, low: Column) -> Column:
    t = lambda k: M.text(k, locale)
    item = lambda k, v: F.concat(F.lit("- "), t(k), F.lit(": "), v.cast("string"))
    return F.concat_ws(
        "\n", F.lit('\n---\n\n<a id="task-context"></a>\n'), F.concat(F.lit("## "), t("task_context")), F.lit(""), item("task", task), item("budget", F.format_number(limit, 0)), item("tokenizer", model), item("high", high), item("medium", medium),
        item("low", low), F.lit('\n---\n\n<a id="in-depth-code"></a>\n'), F.concat(F.lit("## "), t("code")), F.lit(""),
    )


def foot(locale: Column) -> Column:
    return F.concat_ws("\n", F.lit('---\n\n<a id="system-instructions"></a>\n'), F.concat(F.lit("## "), M.text("instructions", locale)), F.lit(""), M.text("body", locale), F.lit(""))


def heading(priority: str, locale: Column) -> Column:
    return F.concat(F.lit("### "), M.fill(M.text("heading", locale), priority=F.lit(priority)), F.lit("\n\n"))


def minimal_head(locale: Column, task: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("# "), M.text("title", locale)), F.lit(""), F.concat(M.text("task", locale), F.lit(": "), task), M.text("minimal", locale), F.lit(""))


def emergency(locale: Column, task: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("# "), M.text("title", locale)), F.lit(""), F.concat(M.text("task", locale), F.lit(": "), task), M.text("emergency", locale), F.lit("\n```text"), F.concat(F.lit("["), M.text("omitted", locale), F.lit("]")), F.lit("```"))


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", effective_language("detected_language", "relative_path"))


def ordered_lines(line: Column, by: Column, sep: str = "\n") -> Column:
    """Aggregate: lines joined in the order of ``by``."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by.alias("o"), line.alias("l")))), lambda x: x["l"]), sep)


def groups(files: DataFrame) -> DataFrame:
    """(request_id, body): a request's files by priority, the whole ladder of forms.

    HIGH files show their code, MEDIUM ones their skeleton, LOW ones a line of
    summary.  ``files`` are ranked, with ``stripped`` and ``skeleton``.
    """
    loc = F.col("loc")
    code = F.coalesce(F.when(F.col("priority") == "HIGH", F.col("stripped")).otherwise(F.col("skeleton")), F.lit(""))
    block = F.concat_ws("\n", block_head(loc), code, F.lit(BLOCK_TAIL))
    bullet = F.concat(F.lit("- `"), F.col("relative_path"), F.lit("`: "), F.col("summary"), F.lit("."))
    parts = files.groupBy("request_id", "loc").agg(*[ordered_lines(F.when(F.col("priority") == p, bullet if p == "LOW" else block), F.col("rank_ord")).alias(p) for p in ("HIGH", "MEDIUM", "LOW")])
    shown = [F.when(F.col(p) != "", F.concat(heading(p, loc), F.col(p))) for p in ("HIGH", "MEDIUM", "LOW")]
    return parts.select("request_id", F.concat_ws("\n", *shown).alias("body"))


def write_markdown(documents: DataFrame, folder: str, key: str, markdown: str = "markdown") -> None:
    """Write each document as a text file of its own, in a folder ``key=...``; null documents give none."""
    documents.where(F.col(markdown).isNotNull()).select(key, F.col(markdown).alias("value")).write.mode("overwrite").partitionBy(key).text(folder)


def read_markdown(spark, folder: str, key: str, markdown: str = "markdown") -> DataFrame:
    """The documents that :func:`write_markdown` wrote."""
    return spark.read.text(folder, wholetext=True).select(key, F.regexp_replace("value", r"\n\z", "").alias(markdown))
