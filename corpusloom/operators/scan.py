"""Which paths are read: ignore rules, tests, binaries, uploads, folders on disk."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.classify import suffix_of

# Fixed values.
IGNORED_DIRS = [".git", ".gradle", ".hg", ".idea", ".mypy_cache", ".nox", ".pytest_cache", ".ruff_cache", ".tox", ".venv", "__pycache__", "build", "dist", "node_modules", "target", "vendor"]
BINARY_SUFFIXES = "7z a avif bin bmp class dll dylib eot exe flac gif gz ico jar jpeg jpg lockb mov mp3 mp4 o obj ogg otf pdf png pyc so tar ttf wasm wav webm webp woff woff2 zip".split()
BROWSER_IGNORED = [*IGNORED_DIRS, ".next", "coverage", "out"]
BROWSER_BINARY = "png jpg jpeg gif webp ico pdf zip gz jar woff woff2 ttf mp4".split()
BROWSER_FILES, BROWSER_BYTES = 400, 500_000


def _parts(path: Column) -> Column:
    return F.split(path, "/")


def _any_of(parts: Column, names: list[str]) -> Column:
    return F.arrays_overlap(parts, F.array(*map(F.lit, names)))


def is_ignored_dir(path: Column) -> Column:
    """Any part, the file's name too, is a built-in ignored name."""
    return _any_of(_parts(path), IGNORED_DIRS)


def is_ignored_project_path(path: Column) -> Column:
    low = F.lower(path)
    return _any_of(_parts(low), [".gradle", ".idea", "build"]) | low.rlike(r"(^|/)res/raw(/|$)")


def is_test(path: Column) -> Column:
    return F.lower(path).rlike(r"(^|/)tests?/|(^|/)test_[^/]*$|_test\.py$|\.(test|spec)\.[jt]sx?$")


def is_binary_suffix(path: Column) -> Column:
    return suffix_of(path).isin(BINARY_SUFFIXES)


def scanned(files: DataFrame, path: str = "relative_path", include_tests: bool = True) -> DataFrame:
    """Rows that a scan keeps; null paths are dropped."""
    p = F.regexp_replace(F.col(path), r"\\", "/")
    keep = ~is_ignored_dir(p) & ~is_ignored_project_path(p) & ~is_binary_suffix(p)
    return files.where(keep if include_tests else keep & ~is_test(p))


def browser_ingest(files: DataFrame, keys: list[str], path: str, order: list[str], n_bytes: Column) -> DataFrame:
    """The first BROWSER_FILES files of each upload folder that a browser would read (a limit of the feature)."""
    p = F.regexp_replace(F.col(path), r"\\", "/")
    low = F.lower(p)
    ok = ~suffix_of(p).isin(BROWSER_BINARY) & ~_any_of(_parts(p), BROWSER_IGNORED) & ~low.rlike(r"(^|/)res/raw(/|$)") & ~low.rlike(r"(^|/)(\.ds_store|package-lock\.json)$") & (n_bytes <= BROWSER_BYTES)
    w = Window.partitionBy(*keys).orderBy(*order)
    return files.where(ok).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= BROWSER_FILES).drop("_n")


def normalize_name(name: Column, ordinal: Column) -> Column:
    """Forward slashes, no empty, ``.`` or ``..`` parts; a name of nothing else becomes a snippet's."""
    parts = F.filter(F.split(F.replace(F.coalesce(name, F.lit("")), F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", ".", ".."))
    path = F.array_join(parts, "/")
    return F.when(path == "", F.concat(F.lit("snippet_"), ordinal.cast("string"), F.lit(".txt"))).otherwise(path)


def request_files(uploads: DataFrame) -> DataFrame:
    """Uploads as files of their requests: (request_id, input_id, relative_path, text, scan_ord).

    Names are normalised; a name that an earlier file of the request has gets
    its ordinal before the suffix; ignored project paths are left out after
    that.  Null content is empty text.
    """
    named = uploads.withColumn("_norm", normalize_name(F.col("name"), F.col("file_ord") + 1))
    w = Window.partitionBy("request_id", "_norm").orderBy("file_ord", "input_id")
    stem, suffix = F.regexp_extract("_norm", r"^(.*?)((?<=[^/])\.[^./]+)?$", 1), F.regexp_extract("_norm", r"^(.*?)((?<=[^/])\.[^./]+)?$", 2)
    renamed = F.when(F.row_number().over(w) > 1, F.concat(stem, F.lit("_"), (F.col("file_ord") + 1).cast("string"), suffix)).otherwise(F.col("_norm"))
    out = named.withColumn("relative_path", renamed).where(~is_ignored_project_path(F.col("relative_path")))
    return out.select("request_id", "input_id", "relative_path", F.coalesce("content", F.lit("")).alias("text"), F.col("file_ord").alias("scan_ord"))


def replace_by_name(uploads: DataFrame) -> DataFrame:
    """The last content of each name of a repo: (repo, name, input_id)."""
    return uploads.groupBy("repo", "name").agg(F.max("input_id").alias("input_id"))


def gitignore_rules(root: str) -> list[tuple[bool, str]]:
    """All ``.gitignore`` files below ``root`` as ordered (negated, regular expression) pairs."""
    rules = []
    found = sorted(os.path.join(at, n) for at, _d, names in os.walk(root) for n in names if n == ".gitignore")
    for file in found:
        base = os.path.relpath(os.path.dirname(file), root).replace(os.sep, "/")
        with open(file, encoding="utf-8") as f:
            for raw in f.read().splitlines():
                line = raw.strip()
                if line and not line.startswith("#"):
                    rules.append(_rule(line, "" if base == "." else base))
    return rules


def _rule(line: str, base: str) -> tuple[bool, str]:
    negated, line = line.startswith("!"), line.removeprefix("!")
    only_dir, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.lstrip("/")
    pattern = "".join({"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(t, t if t.startswith("[") else re.escape(t)) for t in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\]|[^*?\[]+?(?=/?\*|\?|\[|$)|.", line))
    head = (re.escape(base) + "/" if base else "") + ("" if anchored else "(?:.*/)?")
    return negated, f"^{head}{pattern}{'/.*' if only_dir else '(?:/.*)?'}$"


def is_gitignored(path: Column, rules: list[tuple[bool, str]]) -> Column:
    """The last rule that matches decides."""
    out = F.lit(False)
    for negated, pattern in rules:
        out = F.when(path.rlike(pattern), F.lit(not negated)).otherwise(out)
    return out


def scan_directory(spark: SparkSession, root: str, include_tests: bool = True) -> DataFrame:
    """Text files below ``root``: (relative_path, text, n_bytes, scan_ord), decoded on the executors.

    The driver lists names only.  Files with a NUL byte in their first 4096
    bytes, or that no encoding fits, are dropped.
    """
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    names = sorted(os.path.relpath(os.path.join(at, n), root).replace(os.sep, "/") for at, _d, ns in os.walk(root) for n in ns)
    listed = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "relative_path string, scan_ord long")
    kept = scanned(listed, include_tests=include_tests).where(~is_gitignored(F.col("relative_path"), gitignore_rules(root)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, n in zip(b["relative_path"], b["scan_ord"]):
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        data = f.read()
                except OSError:
                    continue
                if b"\0" in data[:4096]:
                    continue
                try:
                    text = data.decode("utf-8")
                except UnicodeDecodeError:
                    text = _guess(data)
                if text is not None:
                    rows.append((path, text, len(data), n))
            yield pd.DataFrame(rows, columns=["relative_path", "text", "n_bytes", "scan_ord"])

    return kept.mapInPandas(read, "relative_path string, text string, n_bytes long, scan_ord long")


def _guess(data: bytes) -> str | None:
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return data.decode("latin-1")
    best = from_bytes(data).best()
    return str(best) if best else None


