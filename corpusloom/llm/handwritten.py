"""Problem 1: files that nobody in the project wrote by hand.

Each file is lexed once and written again in a canonical layout (tokens a
blank apart; a line ends after ``;``, ``{``, ``}`` and ``,`` outside
parentheses).  The original layout is compared with that text:

* expansion: canonical lines per original line; far above one means minified;
* agreement: the share of the original's line ends that are canonical ones;
* uniformity: the share of lines whose shape (kinds of tokens, numbers left
  out) is the same as that of a few others in the file; near one, with names
  that are counted on, means that a tool put them out;
* literals: the share of lines of nothing but literals, their keys and
  separators; near one means data saved as code;
* digests: the share of lines with a checksum, or of those with a version if
  these are fewer; many of them, in a file that is no code, pin packages, as
  lock files do;
* notices: the head comments, read as comments (a string or a comment further
  down that quotes a notice says nothing);
* fingerprint: a hash of the canonical text without its comments.  Copies of
  a third-party file are found by it wherever they are stored: a fingerprint
  that stands under a vendored folder or a library's notice in one place marks
  its copies in all others.

The layout decides first; names of lock files and notices come after it.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import language_of, name_of, suffix_of
from ..sources.tables import spread, written
from .lexer import CODE, lex

LAYOUT = "expansion double, agreement double, longest int, lines int, digests double, uniform double, counted double, data double, tokens int, tool boolean, library string, print long"

# Folders in which package managers and habit keep code of others.
VENDOR_DIRS = "vendor|third_party|third-party|thirdparty|node_modules|external|deps|bower_components|Pods|Carthage|site-packages"
# Head comments of tools, in the languages of the corpus.
TOOL_NOTICE = (
    r"(?i)(\bcode generated\b|@generated\b|<auto-?generated|\bauto-?generated\b|\bautomatically (generated|created)|\bcreated automatically"
    r"|\bgenerated (file|code|by|from)\b|\bmachine[- ](written|generated)|\bdo not (edit|modify)( by hand)?\b[.!]?\s*(regenerate|$)|\bregenerate with\b"
    r"|\boutput of \w+; checked in|\bmanual changes will be lost|автоматически|автоматично|automatisch (erzeugt|generiert)|généré automatiquement"
    r"|generado automáticamente|gerado automaticamente|自动生成|自動生成|स्वचालित)"
)
LIBRARY_NOTICE = r"(?im)^\W*([a-z][\w.-]*) v?\d+\.\d+(\.\d+)?\b[^\n]*\n\W*(\(c\)|copyright|licen[cs]ed)[^\n]*(licen[cs]e|contributors|authors)"
LOCK_NAMES = r"(?i)^(package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|cargo\.lock|poetry\.lock|pdm\.lock|uv\.lock|pipfile\.lock|gemfile\.lock|composer\.lock|go\.sum|podfile\.lock|packages\.lock\.json|pubspec\.lock|mix\.lock|flake\.lock|package\.resolved)$"


# ASCII classes, as in Spark's own regular expressions.
_TOOL, _LIBRARY = re.compile(TOOL_NOTICE, re.ASCII), re.compile(LIBRARY_NOTICE, re.ASCII)
_DIGEST = re.compile(r"\b[0-9a-f]{40,128}\b|\b[0-9a-f]{32}\b|(?:sha\d+[-:]|h1:)[A-Za-z0-9+/]{20,}")
_VERSION = re.compile(r"(?<![\d.])v?\d+\.\d+\.\d+(?![\d.])")
_DATA_LINE = re.compile(r"[\[({]*(?:[sd]?[:=]|=>)?(?:[\[({+-]*[sd][\])}]*[,:;]*)+[\])}]*[,;+.]*")


def canonical(text: str, lang: str) -> tuple[list[str], list[list[str]], list[int], list[str]]:
    """A file in the canonical layout: (its lines, tokens of each original line, canonical line ends among them, head comments).

    Tokens are given with their kind in front; comments are left out.
    """
    made, now, lines, ends, head, depth, body = [], [], [[]], [], [], 0, False
    for kind, a, b in lex(text, lang):
        if kind == "n":
            lines.append([])
            continue
        if kind == "w":
            continue
        piece = text[a:b]
        if kind == "c" or kind == "s" and lang == "python" and not made and not now:
            if not body:
                head.append(piece)
            continue
        body = body or piece not in ("<", "?", "php")
        now.append(piece)
        lines[-1].append(kind + piece)
        if kind == "p":
            depth += (piece in "([") - (piece in ")]")
            if piece in ";{}" or piece == "," and depth <= 0:
                made.append(" ".join(now))
                now = []
                ends.append((len(lines) - 1, len(lines[-1])))
    return made + [" ".join(now)] * bool(now), lines, ends, head


_NUMBER = re.compile(r"(\d+)(?!.*\d)")


def measure(text: str, lang: str) -> tuple:
    """The layout of one file; see the module for the columns."""
    made, lines, ends, head = canonical(text, lang)
    filled = sum(1 for x in lines if x) or 1
    # An original line end agrees if a canonical line ends there, too.
    same = sum(1 for line, n in ends if n == len(lines[line]))
    numbers, shapes, literal = set(), Counter(), 0
    for line in lines:
        if not line:
            continue
        shape, data = [], []
        for t in line:
            kind, piece = t[0], t[1:]
            data.append(piece if kind == "p" else "s" if kind in "sx" else kind)
            counted = kind == "i" and _NUMBER.search(piece)
            if counted:
                numbers.add(int(counted[1]))
            shape.append("i#" if counted else piece if kind in "pi" and len(piece) < 4 else kind)
        literal += bool(_DATA_LINE.fullmatch("".join(data)))
        if len(shape) > 1:
            shapes[" ".join(shape)] += 1
    n, run = sum(shapes.values()), 0
    top = sum(k for _, k in shapes.most_common(4) if k >= 5)
    while run in numbers:
        run += 1
    notices = "\n".join(head)
    library = _LIBRARY.search(notices)
    rows = text.split("\n") if lang not in CODE else []
    digests = min(sum(1 for x in rows if _DIGEST.search(x)), sum(1 for x in rows if _VERSION.search(x)))
    return (
        max(1, len(ends) + 1) / filled, same / filled, max(map(len, text.split("\n"))), filled, digests / filled, top / n if n else 0.0, min(1.0, 4 * run / filled), literal / filled,
        sum(map(len, lines)), bool(_TOOL.search(notices)), library[1].lower() if library else "", xxhash.xxh3_64_intdigest(" ".join(made)) - 2**63,
    )


def layouts(files: DataFrame, text: str, language: str) -> DataFrame:
    """Add the layout columns to ``files``; blank texts are left out."""

    @F.pandas_udf(LAYOUT)
    def udf(t: pd.Series, lang: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([measure(x, y) for x, y in zip(t, lang)], columns=[c.split()[0] for c in LAYOUT.split(", ")])

    return files.where(F.col(text).rlike(r"\S")).withColumn("_l", udf(F.col(text), F.col(language))).select("*", "_l.*").drop("_l")


def _foreign(path: Column, repo: Column) -> Column:
    """Whether a file stands in a vendored folder or carries a library's notice; one that names the repo is the project's own."""
    notice = (F.col("library") != "") & ~F.contains(F.lower(F.coalesce(repo, F.lit(""))), F.col("library"))
    return F.coalesce(path.rlike(rf"(^|/)({VENDOR_DIRS})/") | notice, F.lit(False))


def third_party(measured: DataFrame, path: Column, repo: Column, least_tokens: int = 30) -> DataFrame:
    """Fingerprints of code that is not the project's own.

    A fingerprint counts if one of its places is a vendored folder or carries
    a library's notice, or if several repos hold it.  The grouping combines on
    the map side, so a fingerprint held by a third of all rows is one row per
    task before the shuffle.
    """
    return (
        measured.where(F.col("tokens") >= least_tokens)
        .groupBy("print")
        .agg(F.bool_or(_foreign(path, repo)).alias("_v"), F.min(repo).alias("_a"), F.max(repo).alias("_b"))
        .where(F.col("_v") | (F.col("_a") != F.col("_b")))
        .select("print")
    )


def not_handwritten(files: DataFrame, id_col: str = "input_id", name: str = "name", text: str = "content", repo: str = "repo", salts: int = 16) -> DataFrame:
    """Ids of the files that were not written by hand, with the reason that holds first.

    Columns: the id, ``reason`` (lock, minified, generated, data, vendored) and
    the ``rule`` that found it (layout, name, notice, place, copy).
    Null and blank texts give no row; a null name leaves the path rules out
    and makes the language unknown; a null repo counts as no repo.  Repeated
    rows are decided alike, each under its own id.  An empty table gives an
    empty result; further columns are ignored.
    """
    path = F.regexp_replace(F.coalesce(F.col("_name"), F.lit("")), r"\\", "/")
    base = F.lower(name_of(path))
    language = F.when(base.rlike(r"^\.env|\.env$|^dockerfile$"), "env").otherwise(language_of(path))
    picked = files.select(F.col(id_col).alias("_id"), F.col(name).alias("_name"), F.col(repo).alias("_repo"), F.col(text).alias("_text"))
    picked = picked.where(F.col("_text").rlike(r"\S")).withColumn("_path", path).withColumn("_base", base).withColumn("_lang", language)
    # Written, without the texts: it is read twice, and a filter on it would run the lexer again.
    measured = written(layouts(spread(picked, "_id"), "_text", "_lang").drop("_text", "_name"), "p1-layouts")
    code = F.col("_lang").isin(CODE)
    table = code | F.col("_lang").isin("unknown")
    long_enough = F.col("lines") >= 8

    def because(reason: str, rule: str) -> Column:
        return F.struct(F.lit(reason).alias("reason"), F.lit(rule).alias("rule"))

    found = (
        F.when(~code & (F.col("digests") >= 0.2) & (F.col("digests") * F.col("lines") >= 3), because("lock", "layout"))
        .when(code & ((F.col("expansion") >= 3) & (F.col("longest") >= 200) | (F.col("longest") > 1500) & (F.col("expansion") >= 1.5)), because("minified", "layout"))
        .when(code & long_enough & ((F.col("uniform") >= 0.8) | (F.col("counted") >= 0.9) & (F.col("uniform") >= 0.6)), because("generated", "layout"))
        .when(table & long_enough & (F.col("data") >= 0.85), because("data", "layout"))
        .when(F.col("_base").rlike(LOCK_NAMES), because("lock", "name"))
        .when(F.col("tool"), because("generated", "notice"))
        .when(_foreign(F.col("_path"), F.col("_repo")), because("vendored", "place"))
    )
    judged = measured.withColumn("_found", found)
    marks = third_party(measured, F.col("_path"), F.col("_repo"))
    # Copies of one file may be a third of all rows: the marks are repeated over salts, the rows are not.
    salted = marks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("_mark", F.lit(True))
    rows = judged.select("_id", "_found", "print", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("_salt"))
    return (
        rows.join(salted, ["print", "_salt"], "left")
        .select(F.col("_id").alias(id_col), F.coalesce("_found", F.when(F.col("_mark"), because("vendored", "copy"))).alias("_found"))
        .where(F.col("_found").isNotNull())
        .select(id_col, "_found.*")
    )
