"""Languages, categories and roles of paths, as column expressions (no UDF).

All functions take a column (or its name) holding a path with forward slashes
and return a column.  A null path gives null (booleans: null), an empty path
the value for "no suffix".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix -> language and special file names, needed for equal results.
SUFFIX_LANGUAGE = {
    "c": "c", "cc": "cpp", "cpp": "cpp", "cs": "csharp", "cxx": "cpp", "dart": "dart", "go": "go", "gradle": "gradle",
    "h": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "ini": "ini", "java": "java", "js": "javascript", "json": "json",
    "jsx": "javascript", "kt": "kotlin", "kts": "kotlin", "lock": "lockfile", "md": "markdown", "mjs": "javascript",
    "php": "php", "py": "python", "rb": "ruby", "rs": "rust", "swift": "swift", "toml": "toml", "ts": "typescript",
    "tsx": "typescript", "xml": "xml", "yaml": "yaml", "yml": "yaml",
}
NAME_LANGUAGE = {
    "cargo.lock": "lockfile", "dockerfile": "dockerfile", "gemfile": "ruby", "go.mod": "go", "go.sum": "go",
    "package-lock.json": "lockfile", "pnpm-lock.yaml": "lockfile", "podfile": "ruby", "yarn.lock": "lockfile",
}
SOURCE_SUFFIXES = "c cc cpp cs cxx dart go h hh hpp hxx java js jsx kt kts mjs php py rb rs swift ts tsx".split()
CONFIG_SUFFIXES = "gradle ini json lock md toml xml yaml yml".split()
CONFIG_TERMS = ["api", "config", "layout", "manifest"]
ENTRY_NAMES = ["__main__.py", "app.tsx", "index.ts", "main.py"]
FENCED = [
    "c", "cpp", "csharp", "dart", "dockerfile", "go", "gradle", "ini", "java", "javascript", "json", "kotlin",
    "markdown", "php", "python", "ruby", "rust", "swift", "toml", "typescript", "xml", "yaml",
]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def name_of(path: Column | str) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def suffix_of(path: Column | str) -> Column:
    """Last ``.ext`` of the name, lower case and without the dot; empty if the only dot starts or ends the name."""
    return F.lower(F.regexp_extract(name_of(path), r"^.+\.([^.]+)$", 1))


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def language_of(path: Column | str) -> Column:
    """Language by special file name, then by suffix, else ``unknown``."""
    return F.coalesce(
        F.try_element_at(_map(NAME_LANGUAGE), F.lower(name_of(path))),
        F.try_element_at(_map(SUFFIX_LANGUAGE), suffix_of(path)),
        F.when(_c(path).isNotNull(), F.lit("unknown")),
    )


def effective_language(detected: Column | str, path: Column | str) -> Column:
    """The stored language unless it is null or ``unknown``; then the path decides."""
    return F.coalesce(F.nullif(_c(detected), F.lit("unknown")), language_of(path))


def category_of(path: Column | str) -> Column:
    return (
        F.when(suffix_of(path).isin(SOURCE_SUFFIXES), "source_code")
        .when(suffix_of(path).isin(CONFIG_SUFFIXES) | F.lower(name_of(path)).isin(list(NAME_LANGUAGE)), "config_data")
        .when(_c(path).isNotNull(), "asset")
    )


def is_config_exception(path: Column | str, terms: Column) -> Column:
    return suffix_of(path).isin("json", "xml") & F.arrays_overlap(terms, F.array(*map(F.lit, CONFIG_TERMS)))


def is_android_source(path: Column | str) -> Column:
    return F.lower(_c(path)).rlike(r"(^|/)src/main/(java|kotlin)(/|$)")


def is_entrypoint(path: Column | str) -> Column:
    return _c(path).rlike(r"^src/[^/]+$") | F.lower(name_of(path)).isin(ENTRY_NAMES)


def is_boilerplate(path: Column | str) -> Column:
    name = F.lower(name_of(path))
    return name.rlike(r"^test_.*\.py$") | name.isin("constants.py", "types.ts")


def fence_of(language: Column | str) -> Column:
    return F.when(_c(language).isin(FENCED), _c(language)).otherwise("")
