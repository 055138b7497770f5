"""Fitting a request's document to its token limit.

Tokens are runs of non-blank signs, so those of a document are the sum of
those of its parts.  One pass counts each file in every mode; running sums
over the rank order give every candidate document's size, and the first that
fits is taken.  Only that one is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions.text import approx_tokens, format_limit
from . import render as R
from .compress import snippet

# Modes: 0 is the whole stripped text, others snippets of so many lines.
MODES = [0, 180, 120, 80, 40, 20, 24, 12, 6]
WHOLE, TOP, TINY = [0, 180, 120, 80, 40], [80, 40, 20], [40, 24, 12, 6]
START, ENOUGH = 0.5, 0.75
DEFAULT_LIMIT, MOST_LIMIT = 8_000, 1_000_000
DEBUG_TOKENS = 7


def limits(requests: DataFrame) -> DataFrame:
    """Requests with the limit that holds: default for null, none beyond the bounds; and the locale's code."""
    from ..functions.text import normalize_locale

    n = F.col("token_limit")
    return requests.withColumn("limit", F.when(n.isNull(), DEFAULT_LIMIT).when((n > 0) & (n <= MOST_LIMIT), n)).withColumn("loc", normalize_locale("locale"))


def code_in(mode: Column) -> Column:
    """Over ``compress.parts`` with pieces: a file's code in one of MODES; empty for a file without text."""
    out = F.when(mode == 0, F.col("stripped"))
    for m in MODES[1:]:
        out = out.when(mode == m, snippet(m))
    return F.coalesce(out, F.lit(""))


def block_tokens() -> Column:
    """Over ``compress.parts`` with pieces: tokens of a file's code in each of MODES; the file was taken apart once."""
    return F.array(*[approx_tokens(F.coalesce(snippet(m) if m else F.col("stripped"), F.lit(""))).cast("int") for m in MODES])


def sized(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """Ranked files of requests (request_id, rank_ord, priority, ...) with what each adds to a document.

    Adds ``row_tokens`` (its line of the map, one word for dependencies),
    ``head_tokens``, ``code_tokens`` (array over MODES) and ``dep_tokens``:
    an edge shows once both its ends are in, and of a file's edges the second
    to the sixth add a word.
    """
    loc = F.col("loc")
    known = ranked.withColumn("row_tokens", approx_tokens(R.map_row(F.array().cast("array<string>"), loc))).withColumn("head_tokens", approx_tokens(F.concat(R.block_head(loc), F.lit("\n" + R.BLOCK_TAIL))))
    ends = known.select("request_id", F.col("relative_path").alias("_p"), F.col("rank_ord").alias("_r"))
    shown = edges.join(ends.withColumnsRenamed({"_p": "src", "_r": "_a"}), ["request_id", "src"]).join(ends.withColumnsRenamed({"_p": "dst", "_r": "_b"}), ["request_id", "dst"])
    shown = shown.withColumn("_at", F.greatest("_a", "_b")).withColumn("_k", F.row_number().over(Window.partitionBy("request_id", "src").orderBy("_at", "dst")))
    extra = shown.where("_k between 2 and 6").groupBy("request_id", F.col("_at").alias("rank_ord")).agg(F.count("*").alias("dep_tokens"))
    return known.join(extra, ["request_id", "rank_ord"], "left").fillna(0, ["dep_tokens"])


def attempts(files: DataFrame, requests: DataFrame) -> DataFrame:
    """All candidate documents: request_id, rung, kind, mode, n_high, tokens, limit.

    Rungs: the whole of all HIGH files; snippets of all; snippets of fewer and
    fewer; a minimal document of up to three; the bare task; nothing.
    """
    high = files.where("priority = 'HIGH'")
    order = Window.partitionBy("request_id").orderBy("rank_ord").rowsBetween(Window.unboundedPreceding, 0)
    sums = high.select(
        "request_id",
        F.row_number().over(Window.partitionBy("request_id").orderBy("rank_ord")).alias("n"),
        F.sum(F.col("row_tokens") + F.col("dep_tokens")).over(order).alias("rows"),
        F.sum("head_tokens").over(order).alias("heads"),
        *[F.sum(F.col("code_tokens")[i]).over(order).alias(f"c{m}") for i, m in enumerate(MODES)],
    )
    zero = requests.select("request_id", F.lit(0).alias("n"), *[F.lit(0).cast("long").alias(c) for c in ("rows", "heads", *[f"c{m}" for m in MODES])])
    counts = files.groupBy("request_id").agg(F.sum(F.when(F.col("priority") == "HIGH", 1).otherwise(0)).alias("_h"), F.count("*").alias("_n"))
    loc = F.col("loc")
    base = requests.where("limit is not null").join(counts, "request_id", "left").fillna(0, ["_h", "_n"])
    none = F.lit("")
    base = base.select(
        "request_id", "limit", "_h", F.least(F.lit(3), F.col("_n")).alias("_k"),
        approx_tokens(F.concat_ws("\n", R.head(loc), R.context(loc, F.coalesce("task", none), F.col("limit"), F.lit("words"), F.lit(0), F.lit(0), F.lit(0)), R.foot(loc))).alias("_fix"),
        approx_tokens(R.heading("HIGH", loc)).alias("_head"),
        approx_tokens(R.minimal_head(loc, F.coalesce("task", none))).alias("_min"),
        approx_tokens(R.emergency(loc, F.coalesce("task", none))).alias("_bare"),
        (approx_tokens(M.fill(M.text("warning", loc), limit=format_limit("limit"))) + 1).alias("_warn"),
    )
    rows = base.join(sums.unionByName(zero.select(*sums.columns)), "request_id")
    less = F.greatest(F.col("_h") - 1, F.lit(0))
    full = F.col("_fix") + F.col("rows") + F.col("heads") + F.when(F.col("n") > 0, F.col("_head")).otherwise(0) + DEBUG_TOKENS
    tries = []
    for i, mode in enumerate(WHOLE):
        warn = F.col("_warn") if i else F.lit(0)
        tries.append((F.col("n") == F.col("_h"), F.lit(i + 1), "document", mode, full + F.col(f"c{mode}") + warn))
    for j, mode in enumerate(TOP):
        tries.append(((F.col("n") > 0) & (F.col("n") < F.col("_h")), 5 + j * less + (F.col("_h") - F.col("n")), "document", mode, full + F.col(f"c{mode}") + F.col("_warn")))
    for j, mode in enumerate(TINY):
        # The smallest count that still takes n files: the first one tried is the largest.
        kept = F.col("n") == F.least(F.col("_h"), F.col("_k"))
        fewer = (F.col("n") < F.least(F.col("_h"), F.col("_k"))) & (F.col("n") > 0)
        tokens = F.col("_min") + F.col("heads") + F.col(f"c{mode}") + F.col("_warn") + DEBUG_TOKENS
        first = 5 + 3 * less + j * F.col("_k") + 1
        tries.append((kept & (F.col("_k") > 0), first, "minimal", mode, tokens))
        tries.append((fewer, first + F.col("_k") - F.col("n"), "minimal", mode, tokens))
    after = 5 + 3 * less + len(TINY) * F.col("_k")
    tries.append((F.col("n") == 0, after + 1, "emergency", 0, F.col("_bare") + DEBUG_TOKENS))
    tries.append((F.col("n") == 0, after + 2, "empty", 0, F.lit(0)))
    made = F.filter(
        F.array(*[F.when(on, F.struct(rung.cast("int").alias("rung"), F.lit(kind).alias("kind"), F.lit(mode).alias("mode"), F.col("n").cast("int").alias("n_high"), tokens.cast("long").alias("tokens"))) for on, rung, kind, mode, tokens in tries]),
        lambda x: x.isNotNull(),
    )
    return rows.select("request_id", "limit", F.explode(made).alias("a")).select("request_id", "limit", "a.*")


def first_fit(tried: DataFrame) -> DataFrame:
    """The first candidate of each request that is within its limit."""
    fits = tried.where("tokens <= limit")
    one = F.min_by(F.struct("rung", "kind", "mode", "n_high", "tokens"), "rung")
    return fits.groupBy("request_id", "limit").agg(one.alias("a")).select("request_id", "limit", "a.*")


def filled(chosen: DataFrame, files: DataFrame, requests: DataFrame) -> DataFrame:
    """Chosen documents with MEDIUM files added whole: n_medium and the tokens with them.

    Files are added in rank order while the document is within the limit, up
    to the first that brings it to ENOUGH of it; the first that does not fit
    ends the search, later smaller ones are not tried.
    """
    heading = requests.select("request_id", approx_tokens(R.heading("MEDIUM", F.col("loc"))).alias("_head"))
    open_ = chosen.where((F.col("rung") <= len(WHOLE)) & (F.col("tokens") < F.col("limit") * START)).join(heading, "request_id")
    order = Window.partitionBy("request_id").orderBy("rank_ord")
    cost = F.col("row_tokens") + F.col("dep_tokens") + F.col("head_tokens") + F.col("code_tokens")[0]
    medium = files.where("priority = 'MEDIUM'").select("request_id", F.row_number().over(order).alias("m"), F.sum(cost).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_c"))
    sizes = open_.join(medium, "request_id").withColumn("_t", F.col("tokens") + F.col("_head") + F.col("_c"))
    over = F.min(F.when(F.col("_t") > F.col("limit"), F.col("m")))
    enough = F.min(F.when(F.col("_t") >= F.col("limit") * ENOUGH, F.col("m")))
    stop = sizes.groupBy("request_id").agg(F.least(F.coalesce(over - 1, F.max("m")), F.coalesce(enough, F.max("m"))).alias("n_medium"))
    size = sizes.join(stop, "request_id").where("m = n_medium").select("request_id", "n_medium", F.col("_t").alias("_filled"))
    out = chosen.join(size, "request_id", "left")
    return out.select("request_id", "limit", "rung", "kind", "mode", "n_high", F.coalesce("n_medium", F.lit(0)).cast("int").alias("n_medium"), F.coalesce("_filled", "tokens").alias("tokens"))


def documents(chosen: DataFrame, files: DataFrame, edges: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, markdown, tokens, compression_warning) of every chosen document.

    ``files`` carries ``compress.parts`` and the task's pieces; only the
    files that a document holds are written, and each only in its mode.
    """
    loc = F.col("loc")
    order = Window.partitionBy("request_id", "priority").orderBy("rank_ord")
    plan = chosen.join(requests.select("request_id", F.coalesce("task", F.lit("")).alias("task"), "loc"), "request_id")
    part = files.drop("loc", "task", "limit").withColumn("_k", F.row_number().over(order)).join(plan, "request_id")
    part = part.where(((F.col("priority") == "HIGH") & (F.col("_k") <= F.col("n_high"))) | ((F.col("priority") == "MEDIUM") & (F.col("_k") <= F.col("n_medium"))))
    part = part.withColumn("_mode", F.when(F.col("priority") == "HIGH", F.col("mode")).otherwise(0)).withColumn("code", code_in(F.col("_mode")))
    inside = part.select("request_id", "relative_path")
    kept = edges.join(inside.withColumnRenamed("relative_path", "dst"), ["request_id", "dst"], "left_semi").join(inside.withColumnRenamed("relative_path", "src"), ["request_id", "src"], "left_semi")
    deps = kept.groupBy("request_id", F.col("src").alias("relative_path")).agg(F.slice(F.array_sort(F.collect_list("dst")), 1, 6).alias("deps"))
    part = part.join(deps, ["request_id", "relative_path"], "left")
    block = F.concat_ws("\n", R.block_head(loc), "code", F.lit(R.BLOCK_TAIL))
    by = lambda p: R.ordered_lines(F.when(F.col("priority") == p, block), F.col("rank_ord"), "\n")
    agg = part.groupBy("request_id").agg(R.ordered_lines(R.map_row(F.col("deps"), loc), F.col("rank_ord")).alias("_map"), by("HIGH").alias("_hi"), by("MEDIUM").alias("_me"))
    d = plan.join(agg, "request_id", "left")
    none = F.lit("")
    body = F.concat_ws(
        "\n", R.head(loc), F.coalesce("_map", none), R.context(loc, F.col("task"), F.col("limit"), F.lit("words"), F.col("n_high"), F.col("n_medium"), F.lit(0)),
        F.when(F.col("n_high") > 0, F.concat(R.heading("HIGH", loc), F.col("_hi"))).otherwise(none), F.when(F.col("n_medium") > 0, F.concat(R.heading("MEDIUM", loc), F.col("_me"))).otherwise(none), R.foot(loc),
    )
    markdown = F.when(F.col("kind") == "document", body).when(F.col("kind") == "minimal", F.concat_ws("\n", R.minimal_head(loc, F.col("task")), F.coalesce("_hi", none))).when(F.col("kind") == "emergency", R.emergency(loc, F.col("task")))
    warning = F.when(F.col("rung") > 1, M.fill(M.text("warning", loc), limit=format_limit("limit")))
    shown = F.when((F.col("rung") > 1) & (F.col("kind") != "emergency"), F.concat(F.lit("\n\n> "), warning, F.lit("\n"))).otherwise(none)
    strategy = F.when(F.col("rung") == 1, "FullCode").otherwise("Snipped")
    debug = F.concat(F.lit("\n\n"), M.fill(M.text("debug", loc), budget=F.col("limit"), used=F.col("tokens"), strategy=strategy), F.lit("\n"))
    return d.select("request_id", F.when(F.col("kind") == "empty", none).otherwise(F.concat(F.rtrim(F.concat(F.rtrim(markdown), shown)), debug)).alias("markdown"), "tokens", warning.alias("compression_warning"))
