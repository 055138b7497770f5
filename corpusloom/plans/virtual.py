"""A repository made of the documents table: paths by rule, imports written into the texts.

It gives the graph operators a single graph that grows with the data and has
a hub, a file that a good third of all others import.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import language_of
from ..functions.text import terms
from ..operators import imports as I
from ..operators import resolve
from ..sources.tables import cut, spread, table

TASK = "fix the roster ledger with an invoice"

_EXT = "CASE WHEN {i} % 10 < 5 THEN '.py' WHEN {i} % 10 = 5 THEN '.ts' WHEN {i} % 10 = 6 THEN '.kt' WHEN {i} % 10 = 7 THEN '.json' WHEN {i} % 10 = 8 THEN '.md' ELSE '.go' END"


def path_sql(i: str) -> str:
    """Path of document ``i`` as SQL that Spark and DuckDB share."""
    ext = _EXT.format(i=i)
    return (
        f"CASE WHEN {i} % 11 = 0 THEN concat('src/doc_', {i}, {ext}) WHEN {i} % 17 = 3 THEN concat('tests/part_', {i} % 7, '/test_doc_', {i}, '.py') "
        f"WHEN {i} % 10 = 6 THEN concat('app/src/main/kotlin/part_', {i} % 7, '/Doc', {i}, '.kt') ELSE concat('pkg/part_', {i} % 7, '/doc_', {i}, {ext}) END"
    )


TARGETS = [("doc_id % 4 = 1", "doc_id - doc_id % 25"), ("doc_id % 5 = 2", "CAST(floor(doc_id / 3) AS BIGINT)"), ("doc_id % 3 <> 0", "CAST(0 AS BIGINT)")]


def text_sql() -> str:
    """Text of a document with import lines in its language, in front."""
    lines = []
    for on, target in TARGETS:
        p = path_sql(f"({target})")
        bare = f"regexp_replace({p}, '[.][a-z]+$', '')"
        dotted = f"replace({bare}, '/', '.')"
        line = (
            f"CASE WHEN path LIKE '%.py' THEN concat('import ', {dotted}, chr(10)) WHEN path LIKE '%.ts' THEN concat('import {{ x }} from ', chr(34), '/', {p}, chr(34), ';', chr(10)) "
            f"WHEN path LIKE '%.kt' THEN concat('import ', {dotted}, chr(10)) WHEN path LIKE '%.go' THEN concat('import ', chr(34), 'mod.example/', {bare}, chr(34), chr(10)) ELSE '' END"
        )
        lines.append(f"CASE WHEN {on} THEN {line} ELSE '' END")
    return f"concat({', '.join(lines)}, coalesce(text, ''))"


_MADE: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make) -> DataFrame:
    """A table of the made repository, written once an application."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _MADE:
        _MADE[key] = cut(make())
    return _MADE[key]


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, relative_path, text, language, scan_ord) of the made repository."""

    def make() -> DataFrame:
        d = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("path", F.expr(path_sql("doc_id")))
        out = d.select("doc_id", F.col("path").alias("relative_path"), F.expr(text_sql()).alias("text"), F.col("doc_id").alias("scan_ord"))
        return spread(out.withColumn("language", language_of("relative_path")), "doc_id")

    # Written: filters on text and path would otherwise be pushed into the rules above, over and over.
    return _once(spark, sf_dir, "files", make)


def words() -> Column:
    return terms(F.lit(TASK))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.imports(files(spark, sf_dir), [], exact_python=False)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the made repository, extracted and resolved; written, as the graph operators read them often."""
    f = files(spark, sf_dir)
    return _once(spark, sf_dir, "edges", lambda: resolve.edges(I.imports(f, [], exact_python=False), f, []))


# The same for DuckDB; which imports resolve follows from the languages' endings.
DUCK_FILES = f"v AS (SELECT doc_id, path AS relative_path, {text_sql()} AS text, doc_id AS scan_ord FROM (SELECT doc_id, text, {path_sql('doc_id')} AS path FROM documents))"
_T = " UNION ALL ".join(f"SELECT doc_id, relative_path AS src, {t.replace('floor(doc_id / 3)', 'doc_id // 3')} AS t FROM v WHERE {on}" for on, t in TARGETS)
DUCK_EDGES = (
    f"aim AS ({_T}), e AS (SELECT DISTINCT a.src, b.relative_path AS dst FROM aim a JOIN v b ON b.doc_id = a.t "
    "WHERE (a.src LIKE '%.py' AND b.relative_path LIKE '%.py') OR a.src LIKE '%.ts' OR (a.src LIKE '%.kt' AND (b.relative_path LIKE '%.kt' OR b.relative_path LIKE '%.go')) OR (a.src LIKE '%.go' AND b.relative_path LIKE '%.go'))"
)
