"""Terms, token counts, summaries, limits and locales as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .classify import name_of

# Fixed values.
STOP_WORDS = ["a", "an", "and", "fix", "for", "from", "in", "of", "on", "the", "to", "with"]
LOCALES = ["en", "ru", "zh", "ja", "hi"]
LEXICAL_CHARS = 50_000
COST_PER_TOKEN = 0.000015


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def terms(task: Column | str, stop: bool = True) -> Column:
    """Distinct lower-case words of more than two signs, without the ranking's stop words unless told."""
    words = F.array_distinct(F.transform(F.regexp_extract_all(_c(task), F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.lower))
    return F.filter(words, lambda w: (F.length(w) > 2) & (~w.isin(STOP_WORDS) if stop else F.lit(True)))


def contains_term(text: Column | str, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(F.lower(_c(text)), w))


def lexical_score(path: Column, text: Column, words: Column) -> Column:
    """Occurrences of all terms, not overlapping, in the path and the head of the text."""
    hay = F.lower(F.concat(path, F.lit("\n"), F.substring(F.coalesce(text, F.lit("")), 1, LEXICAL_CHARS)))
    return F.aggregate(
        words,
        F.lit(0).cast("long"),
        lambda n, w: n + ((F.length(hay) - F.length(F.replace(hay, w, F.lit("")))) / F.length(w)).cast("long"),
    )


def approx_tokens(text: Column | str) -> Column:
    """Runs of anything but white space; zero for null."""
    return F.coalesce(F.size(F.filter(F.split(_c(text), r"(?U)\s+"), lambda x: x != "")), F.lit(0)).cast("long")


def summary(path: Column | str, imports: Column) -> Column:
    name = name_of(path)
    stem = F.when(name.rlike(r"^.+\.[^.]+$"), F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)).otherwise(name)
    stem = F.translate(stem, "_-", "  ")
    three = F.array_join(F.slice(F.array_sort(imports), 1, 3), ", ")
    return F.when(F.coalesce(F.size(imports), F.lit(0)) > 0, F.concat(stem, F.lit("; imports "), three)).otherwise(F.concat(stem, F.lit(" source file")))


def parse_limit(text: Column | str) -> Column:
    """``8k``, ``1 M`` or ``500`` as a number; null where it is none of these."""
    t = _c(text)
    pattern = r"^\s*([0-9]+)\s*([kKmM]?)\s*$"
    unit = F.lower(F.regexp_extract(t, pattern, 2))
    times = F.when(unit == "k", 1000).when(unit == "m", 1_000_000).otherwise(1)
    return F.when(t.rlike(pattern), F.expr("try_cast(0 as bigint)") + F.regexp_extract(t, pattern, 1).try_cast("long") * times)


def format_limit(limit: Column | str) -> Column:
    n = _c(limit)
    return F.when((n >= 1000) & (n % 1000 == 0), F.concat((n / 1000).cast("long").cast("string"), F.lit("k"))).otherwise(F.concat(F.format_number(n, 0), F.lit(" tokens")))


def normalize_locale(locale: Column | str) -> Column:
    head = F.substring_index(F.lower(F.coalesce(_c(locale), F.lit("en"))), "-", 1)
    return F.when(head.isin(LOCALES), head).otherwise("en")


def format_tokens(n: Column) -> Column:
    return F.when(n >= 1000, F.concat(F.format_number(n / 1000, 1), F.lit("k"))).otherwise(n.cast("string"))


def format_cost(tokens: Column) -> Column:
    """What tokens cost, in dollars and cents."""
    return F.concat(F.lit("$"), F.format_number(tokens * COST_PER_TOKEN, 2))


def trim_line(line: Column, most: int = 220) -> Column:
    return F.when(F.length(line) > most, F.concat(F.rtrim(F.substring(line, 1, most)), F.lit(" ..."))).otherwise(line)


def clean_import(name: Column) -> Column:
    cut = F.substring_index(F.substring_index(F.trim(name), "?", 1), "#", 1)
    return F.regexp_replace(cut, "^file://", "")
