"""From a request's files to its document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.classify import language_of
from ..functions.text import summary, terms
from ..operators import budget, compress, imports, rank, render, resolve, scan
from ..sources.tables import cut, written


@dataclass
class Context:
    """The parts of an answer, all keyed by request_id."""

    ranked: DataFrame  # files that are kept, with rank_ord, reasons and reason
    edges: DataFrame
    documents: DataFrame  # markdown, tokens, compression_warning
    choice: DataFrame  # the candidate that was taken
    attempts: DataFrame

    def results(self) -> DataFrame:
        """One row a request: the document with its nodes, edges and counts."""
        node = F.struct(F.col("relative_path").alias("id"), "language", "priority", "reason", "importance_score", "graph_distance")
        per = self.ranked.groupBy("request_id").agg(
            F.count("*").alias("files_kept"), F.array_sort(F.collect_list(F.struct("rank_ord", node.alias("node")))).alias("_n"), *[F.count(F.when(F.col("priority") == p, 1)).alias(f"_{p}") for p in ("HIGH", "MEDIUM", "LOW")]
        )
        links = self.edges.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target")))).alias("edges"))
        counts = F.create_map(*[x for p in ("HIGH", "MEDIUM", "LOW") for x in (F.lit(p), F.coalesce(f"_{p}", F.lit(0)))])
        out = self.documents.join(per, "request_id", "left").join(links, "request_id", "left")
        return out.select(
            "request_id", "markdown", "tokens", F.coalesce("files_kept", F.lit(0)).alias("files_kept"), counts.alias("priority_counts"), F.transform(F.coalesce("_n", F.array()), lambda x: x["node"]).alias("nodes"),
            F.coalesce("edges", F.array()).alias("edges"), "compression_warning",
        )

    def metrics(self) -> DataFrame:
        """One row a request: files by priority, tokens and limit."""
        limit = self.choice.select("request_id", "limit")
        n = [F.col("priority_counts")[p].alias(p.lower()) for p in ("HIGH", "MEDIUM", "LOW")]
        return self.results().join(limit, "request_id").select("request_id", "files_kept", *n, "tokens", "limit")


def request_corpus(inputs: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, relative_path, text, scan_ord, language, task, limit, loc, words) of all files of all requests.

    Requests without a usable limit or task are left out, as they are refused.
    """
    ok = budget.limits(requests).where(F.col("limit").isNotNull() & (F.trim("task") != ""))
    f = scan.request_files(inputs).join(ok.select("request_id", "task", "limit", "loc"), "request_id")
    return f.withColumn("language", language_of("relative_path")).withColumn("words", terms(F.col("task")))


def ranked_files(corpus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranked files and edges of all requests.  A request's files are few, so plain windows order them."""
    keys = ["request_id"]
    found = cut(imports.imports(corpus, keys))
    edges = cut(resolve.edges(found, corpus, keys))
    names = found.groupBy("request_id", F.col("src").alias("relative_path")).agg(F.collect_set("import_name").alias("_imports"))
    r = rank.ranked(corpus.select("request_id", "relative_path", "text", "scan_ord", "language", "task", "limit", "loc", "words"), edges, keys, F.col("words"))
    s, c, d, x, p = F.col("lexical_score"), F.col("centrality"), F.col("graph_distance"), F.col("importance_score"), F.col("relative_path")
    r = r.withColumn("reasons", rank.reasons(s, c, d, x, p, F.col("words"))).withColumn("reason", render.localized_reason(F.col("reasons"), F.col("loc")))
    r = r.withColumn("rank_ord", F.row_number().over(Window.partitionBy("request_id").orderBy(*rank.rank_order())))
    r = r.join(names, ["request_id", "relative_path"], "left").withColumn("summary", summary("relative_path", F.col("_imports"))).drop("_imports")
    return cut(r), edges


def build(inputs: DataFrame, requests: DataFrame) -> Context:
    """Documents of all requests within their token limits."""
    corpus = written(request_corpus(inputs, requests), "corpus")
    ranked, edges = ranked_files(corpus)
    # Every file is taken apart once; sizes and documents are made from its parts.
    ids = ["request_id", "relative_path"]
    apart = compress.parts(corpus.join(ranked.select(*ids), ids, "left_semi"), ids)
    with_parts = ranked.join(apart, ids, "left").withColumn("pieces", compress.pieces(F.col("words"))).drop("lines", "declarations")
    with_parts = written(with_parts, "parts")
    sized = cut(budget.sized(with_parts.withColumn("code_tokens", budget.block_tokens()).drop("stripped", "skeleton", "pieces"), edges))
    ok = budget.limits(requests).join(corpus.select("request_id").distinct(), "request_id", "left_semi")
    tried = cut(budget.attempts(sized, ok))
    choice = cut(budget.filled(budget.first_fit(tried), sized, ok))
    documents = budget.documents(choice, with_parts, edges, ok)
    return Context(sized, edges, documents, choice, tried)


def build_context(spark: SparkSession, files: DataFrame, task: str, token_limit: int = budget.DEFAULT_LIMIT, locale: str = "en") -> Context:
    """One document for one task over ``files`` (relative_path, text): the single-request form of :func:`build`."""
    inputs = files.select(F.lit(0).cast("long").alias("request_id"), F.monotonically_increasing_id().alias("input_id"), F.col("relative_path").alias("name"), F.col("text").alias("content"))
    inputs = inputs.withColumn("file_ord", F.col("input_id").cast("long"))
    requests = spark.createDataFrame([(0, task, token_limit, locale)], "request_id long, task string, token_limit int, locale string")
    return build(inputs, requests)
