"""Settings packed into a link: JSON as base64 for addresses, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LOCALES

SETTINGS = "task string, tokenLimit double, locale string"
DEFAULT_LIMIT, MOST_LIMIT = 8_000, 1_000_000


def packed(task: Column, limit: Column, locale: Column) -> Column:
    """The link of settings; nulls are left out."""
    body = F.to_json(F.struct(task.alias("task"), limit.alias("tokenLimit"), locale.alias("locale")))
    code = F.regexp_replace(F.base64(F.encode(body, "utf-8")), r"[\r\n=]", "")
    return F.translate(code, "+/", "-_")


def unpacked(link: Column) -> Column:
    """(task, token_limit, locale) of a link; null if it is none.

    A missing task is empty; a missing limit is the default, others are
    rounded and kept within the bounds; an unknown locale is English.
    """
    plain = F.translate(link, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4))))
    raw = F.when(plain.rlike("^[A-Za-z0-9+/]+$") & (F.length(plain) % 4 != 1), padded)
    body = F.try_validate_utf8(F.unbase64(raw).cast("string"))
    v = F.from_json(F.when(body.rlike(r"(?s)^\s*\{.*\}\s*$") & F.expr("true"), body), SETTINGS, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    limit = F.round(F.coalesce(v["tokenLimit"], F.lit(float(DEFAULT_LIMIT))))
    out = F.struct(
        F.coalesce(v["task"], F.lit("")).alias("task"), F.greatest(F.lit(1.0), F.least(F.lit(float(MOST_LIMIT)), limit)).cast("long").alias("token_limit"),
        F.when(v["locale"].isin(LOCALES), v["locale"]).otherwise("en").alias("locale"),
    )
    return F.when(v.isNotNull() & F.get_json_object(body, "$").isNotNull(), out)
