"""Scores, priorities and reasons of files for a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions.text import lexical_score
from ..sources.tables import cut
from .graph import distances, in_degree, seeds

# Fixed values of the score.
DROP, MEDIUM, HIGH, CENTRAL, LARGE = 0.3, 0.45, 1.0, 0.25, 20_000
FALLBACK_NAMES = ["__main__.py", "app.py", "cli.py", "index.js", "index.ts", "main.go", "main.py", "main.ts", "app.tsx", "server.js"]


def lexical_part(s: Column) -> Column:
    return F.when(s == 0, 0.0).otherwise(1.0 + F.least(F.lit(2.5), F.log1p(s.cast("double")) * 1.4))


def decay(d: Column) -> Column:
    return F.when(d.isNull(), 0.25).when(d <= 1, 1.0).otherwise(F.exp(-1.25 * (d - 1)))


def proximity(d: Column) -> Column:
    return F.when(d.isNull(), 0.0).when(d <= 1, 0.85).otherwise(F.exp(-1.25 * (d - 1)) * 0.85)


def importance(s: Column, c: Column, d: Column, path: Column, words: Column) -> Column:
    """The score before it is compared with any limit; additions in this order."""
    graph = lexical_part(s) + c * 1.6 * decay(d) + proximity(d) + F.when(C.is_entrypoint(path), 0.2).otherwise(0.0)
    role = F.when(C.category_of(path) == "source_code", 0.05).otherwise(0.0) + F.when(C.is_android_source(path), 0.45).otherwise(0.0) + F.when(C.is_config_exception(path, words), 0.2).otherwise(0.0)
    x = graph + role
    x = F.when((s == 0) & C.is_boilerplate(path), x * 0.35).otherwise(x)
    capped = F.when(s > 0, F.least(x * 0.55, F.lit(0.95))).otherwise(x * 0.2)
    return F.when(is_limited(path, words), capped).otherwise(x)


def is_limited(path: Column, words: Column) -> Column:
    return (C.category_of(path) == "config_data") & ~C.is_config_exception(path, words)


def priority(x: Column, s: Column, c: Column, d: Column, path: Column, words: Column) -> Column:
    near = F.coalesce(d.isin(0, 1), F.lit(False))
    strong = (s > 0) | (c >= CENTRAL) | (C.is_entrypoint(path) & near)
    by_score = F.when(x >= MEDIUM, "MEDIUM").otherwise("LOW")
    return (
        F.when(is_limited(path, words), F.when((s > 0) & (x >= MEDIUM), "MEDIUM").otherwise("LOW"))
        .when((s == 0) & C.is_boilerplate(path), by_score)
        .when((x >= HIGH) & strong, "HIGH")
        .otherwise(by_score)
    )


REASON = "struct<code:string,score:double,metadata:struct<matches:bigint,centrality:double,distance:int,final_score:double>>"


def reasons(s: Column, c: Column, d: Column, x: Column, path: Column, words: Column) -> Column:
    """Why a file has its score, as an array of (code, score, metadata)."""

    def one(on: Column, code: str, score: Column, **meta: Column) -> Column:
        m = F.struct(
            *[meta.get(k, F.lit(None)).cast(t).alias(k) for k, t in (("matches", "bigint"), ("centrality", "double"), ("distance", "int"), ("final_score", "double"))]
        )
        return F.when(on, F.struct(F.lit(code).alias("code"), score.cast("double").alias("score"), m.alias("metadata")))

    source = C.category_of(path) == "source_code"
    android = C.is_android_source(path)
    limited = is_limited(path, words)
    own = F.filter(
        F.array(
            one(s > 0, "TASK_MATCH", F.least(F.lit(1.0), F.log1p(s.cast("double")) / 3), matches=s),
            one(c >= CENTRAL, "CORE_ARCH", F.least(F.lit(1.0), c), centrality=F.round(c, 3)),
            one(d.isNotNull(), "GRAPH_DISTANCE", decay(d), distance=d),
            one(android, "ANDROID_SOURCE", F.lit(0.45)),
            one(source & ~android, "SOURCE_FILE", F.lit(0.05)),
            one(C.is_entrypoint(path), "ENTRY_POINT", F.lit(0.2)),
            one(C.is_config_exception(path, words), "CONFIG_MATCH", F.lit(0.2)),
            one((s == 0) & C.is_boilerplate(path), "BOILERPLATE_PENALTY", F.lit(-0.65)),
            one(limited, "CONFIG_PRIORITY_CAP", F.lit(-0.45)),
        ),
        lambda r: r.isNotNull(),
    )
    background = F.array(one(F.lit(True), "BACKGROUND_CONTEXT", F.lit(0.1)))
    final = F.array(one(F.lit(True), "FINAL_SCORE", x, final_score=F.round(x, 2)))
    return F.concat(F.when(F.size(own) > 0, own).otherwise(background), final)


def scored(files: DataFrame, words: Column) -> DataFrame:
    return files.withColumn("lexical_score", lexical_score(F.col("relative_path"), F.col("text"), words))


def features(files: DataFrame, edges: DataFrame, keys: list[str], words: Column) -> DataFrame:
    """Files with lexical_score, centrality, graph_distance and importance_score, none dropped.

    ``files``: keys, relative_path (unique within keys), text, scan_ord and
    what ``words`` reads.  Null text counts as empty; a graph without matches
    starts from its entry points.
    """
    with_s = scored(files, words).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)))
    light = cut(with_s.drop("text"))  # scored once: seeds and scores read it again
    start = seeds(light.select(*keys, "relative_path", "scan_ord", "lexical_score"), keys, C.name_of("relative_path").isin(FALLBACK_NAMES))
    dist = distances(edges, start, keys).withColumnRenamed("distance", "graph_distance")
    degree = in_degree(files.select(*keys, "relative_path"), edges, keys).select(*keys, "node", "centrality")
    out = light.withColumnRenamed("relative_path", "node").join(degree, [*keys, "node"], "left").join(dist, [*keys, "node"], "left").withColumnRenamed("node", "relative_path")
    s, c, d = F.col("lexical_score"), F.col("centrality"), F.col("graph_distance")
    return out.withColumn("importance_score", importance(s, c, d, F.col("relative_path"), words))


def ranked(files: DataFrame, edges: DataFrame, keys: list[str], words: Column) -> DataFrame:
    """Features of the files that are kept, with ``priority``; files below the drop limit have no row."""
    f = features(files, edges, keys, words)
    s, c, d, x = F.col("lexical_score"), F.col("centrality"), F.col("graph_distance"), F.col("importance_score")
    kept = f.where((x >= DROP) & ~((s == 0) & (F.col("n_bytes") > LARGE)))
    return kept.withColumn("priority", priority(x, s, c, d, F.col("relative_path"), words))


def rank_order() -> list[Column]:
    """The total order of ranked files."""
    p = F.when(F.col("priority") == "HIGH", 0).when(F.col("priority") == "MEDIUM", 1).otherwise(2)
    return [p.asc(), F.coalesce("graph_distance", F.lit(99)).asc(), F.desc("importance_score"), F.desc("lexical_score"), F.asc("relative_path")]
