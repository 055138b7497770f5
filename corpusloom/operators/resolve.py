"""Resolving imports to files: candidates exploded, lookups as equi-joins, the first match wins.

"Starts with k/" is the same as "k is an ancestor folder", "ends with /k" the
same as "k is a proper tail of the path": both become keys of a lookup table,
so no prefix or suffix comparison is left for a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_import
from ..sources.tables import salted

# Endings tried, in order.
JS = ["ts", "tsx", "js", "jsx", "mjs", "cjs"]
DOTTED = ["kt", "kts", "java", "cs", "swift", "go", "rs"]
PATHS = ["c", "cc", "cpp", "cs", "cxx", "dart", "go", "h", "hh", "hpp", "hxx", "java", "kt", "kts", "php", "rb", "rs", "swift"]


def _tidy(path: Column) -> Column:
    """As a path library writes it: no empty and no ``.`` parts; ``..`` stays."""
    return F.array_join(F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")), "/")


def _dir(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _endings(names: list[str], index: bool, init: bool = False) -> Column:
    more = [f".{e}" for e in names] + (["/__init__.py"] if init else []) + ([f"/index.{e}" for e in names] if index else [])
    return F.array(*map(F.lit, more))


def _has_suffix(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).rlike(r"^.+\.[^.]+$")


DOTTED_LANGUAGES = ["java", "kotlin", "csharp", "swift"]


def candidates(rows: DataFrame, language: str, src: str, name: str) -> DataFrame:
    """Add ``candidates``, the paths to try in order for an import ``name`` of a file ``src``.

    In steps of a column each, so that no expression is computed twice.
    """
    lang, n = F.col(language), F.col(name)
    relative, dotted = F.startswith(n, F.lit(".")), F.replace(n, F.lit("."), F.lit("/"))
    script = F.when(relative, F.concat_ws("/", "_dir", n)).otherwise(n)
    up = F.array_join(F.slice(F.split("_dir", "/"), 1, F.greatest(F.size(F.split("_dir", "/")) - (F.col("_level") - 1), F.lit(0))), "/")
    python = F.when(relative, F.concat_ws("/", up, F.replace(F.regexp_extract(n, r"^\.*(.*)$", 1), F.lit("."), F.lit("/")))).otherwise(dotted)
    rust = F.concat_ws("/", "_dir", F.replace(F.regexp_replace(n, "^(crate|self|super)::", ""), F.lit("::"), F.lit("/")))
    is_dotted = lang.isin(DOTTED_LANGUAGES) & F.contains(n, F.lit("."))
    is_space = (lang == "php") & F.contains(n, F.lit("\\"))
    is_package = (lang == "dart") & F.startswith(n, F.lit("package:"))
    base = (
        F.when(lang == "python", python)
        .when(lang == "rust", rust)
        .when(is_dotted, dotted)
        .when(is_space, F.replace(F.replace(n, F.lit("\\"), F.lit("/")), F.lit("."), F.lit("/")))
        .when(is_package, F.concat(F.lit("lib/"), F.regexp_extract(n, "^package:(?:[^/]*/)?(.*)$", 1)))
        .otherwise(script)
    )
    ends = (
        F.when(lang == "python", _endings(["py"], True, init=True))
        .when(lang.isin("javascript", "typescript"), _endings(JS, True))
        .when(lang == "go", _endings(["go"], False))
        .when(lang == "rust", _endings(["rs"], False))
        .when(is_dotted, _endings(DOTTED, False))
        .when(is_space, _endings(["php"], False))
        .when(lang == "dart", F.when(is_package, _endings(["dart"], False)).otherwise(_endings(["dart"], True)))
        .otherwise(_endings(PATHS, True))
    )

    def expand(at: str) -> Column:
        return F.when(F.col(at + "_suffix"), F.array(at)).otherwise(F.concat(F.array(at), F.transform("_ends", lambda e: F.concat(F.col(at), e))))

    last = F.when((lang == "go") & F.contains(n, F.lit("/")), F.substring_index(n, "/", -1))
    tidy = lambda c: F.coalesce(F.nullif(_tidy(c), F.lit("")), F.lit("."))
    out = rows.withColumns({"_dir": _dir(F.col(src)), "_level": F.length(F.regexp_extract(n, r"^(\.*)", 1))})
    out = out.withColumns({"_base": tidy(base), "_ends": ends, "_last": last})
    out = out.withColumns({"_base_suffix": _has_suffix(F.col("_base")), "_last_suffix": F.coalesce(_has_suffix(F.col("_last")), F.lit(False))})
    more = F.when(lang == "rust", F.array(F.concat("_base", F.lit("/mod.rs")))).when(F.col("_last").isNotNull(), expand("_last")).otherwise(F.array().cast("array<string>"))
    return out.withColumn("candidates", F.concat(expand("_base"), more)).drop("_dir", "_level", "_base", "_ends", "_last", "_base_suffix", "_last_suffix")


def lookup_keys(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, key, kind, path): 0 the path itself, 2 first file of a package, 3 the only file with a tail."""
    parts = F.split("relative_path", "/")
    n = F.size(parts)
    p = files.select(*keys, F.col("relative_path").alias("path"), parts.alias("_p"), n.alias("_n")).distinct()
    exact = p.select(*keys, F.col("path").alias("key"), F.lit(0).alias("kind"), "path")
    folders = F.transform(F.sequence(F.lit(1), F.col("_n") - 1), lambda i: F.array_join(F.slice("_p", 1, i), "/"))
    tails = F.transform(F.sequence(F.lit(2), F.col("_n")), lambda i: F.array_join(F.slice("_p", i, F.col("_n")), "/"))
    deep = p.where("_n > 1")
    go_or_rust = F.filter(F.transform(tails, lambda t: F.when(t.endswith(".go"), F.regexp_replace(t, r"\.go$", "")).when(t.endswith("/mod.rs"), F.regexp_replace(t, "/mod.rs$", ""))), lambda t: t.isNotNull())
    package = deep.select(*keys, F.explode(F.array_distinct(F.concat(folders, go_or_rust))).alias("key"), "path").groupBy(*keys, "key").agg(F.min("path").alias("path"))
    unique = deep.select(*keys, F.explode(tails).alias("key"), "path").groupBy(*keys, "key").agg(F.count("*").alias("_c"), F.min("path").alias("path")).where("_c = 1")
    return exact.unionByName(package.select(*keys, "key", F.lit(2).alias("kind"), "path")).unionByName(unique.select(*keys, "key", F.lit(3).alias("kind"), "path"))


def tried(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, import_name, cand_ord, candidate) of imports; addresses on the web and empty names have none."""
    name = clean_import(F.col("import_name"))
    some = found.withColumn("_name", name).where((F.col("_name") != "") & ~F.col("_name").rlike("^https?://"))
    return candidates(some, "language", "src", "_name").select(*keys, "src", "import_name", F.posexplode("candidates").alias("cand_ord", "candidate"))


def resolved(found: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, import_name, dst): the first candidate with a file, by path, package, then only tail."""
    all_tried = tried(found, keys)
    table = lookup_keys(files, keys)
    trimmed = F.regexp_replace(F.regexp_replace(F.col("candidate"), "^/+|/+$", ""), r"^\./", "")
    both = all_tried.withColumn("_t", trimmed).withColumn("_bare", (F.col("_t") != "") & ~_has_suffix(F.col("_t")))
    # One row for the path and the tail, one for the package if the candidate can be one.
    probes = F.when(F.col("_bare"), F.array(F.struct(F.col("candidate").alias("key"), F.lit(False).alias("_pkg")), F.struct(F.col("_t").alias("key"), F.lit(True).alias("_pkg")))).otherwise(
        F.array(F.struct(F.col("candidate").alias("key"), F.lit(False).alias("_pkg")))
    )
    hits = both.select(*keys, "src", "import_name", "cand_ord", F.explode(probes).alias("_q")).select(*keys, "src", "import_name", "cand_ord", "_q.*")
    # Many imports probe one key: the keys are made distinct before the shuffle, and what they
    # found, one row a key, is repeated over salts for the imports that share it.
    wanted = hits.select(*keys, "key").distinct()
    at = lambda k: F.max(F.when(F.col("kind") == k, F.col("path"))).alias(f"_{k}")
    known = table.join(wanted, [*keys, "key"], "left_semi").groupBy(*keys, "key").agg(at(0), at(2), at(3))
    hits = salted(hits, known, [*keys, "key"], ["src", "import_name", "cand_ord"])
    hits = hits.withColumn("path", F.when(F.col("_pkg"), F.col("_2")).otherwise(F.coalesce("_0", "_3"))).withColumn("kind", F.when(F.col("_pkg"), 2).when(F.col("_0").isNotNull(), 0).otherwise(3)).where("path is not null")
    best = F.min_by("path", F.struct("cand_ord", "kind"))
    return hits.groupBy(*keys, "src", "import_name").agg(best.alias("dst"))


def edges(found: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (keys, src, dst); a file that imports itself keeps that edge."""
    return resolved(found, files, keys).select(*keys, "src", "dst").distinct()
