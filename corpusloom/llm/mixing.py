"""Problem 7: mixing sources to target weights.

Sizes are tokens of a public tokenizer, counted once per document.  The target
size of a mix is shared among its sources by capped water-filling: a source
gives at most ``max_repeats`` times its size, and what it can't give goes to
the others in proportion to their weights, until all fit.  With sources in the
order of the level at which they are full this has a closed form, so it is
window sums over the few rows of each mix, not a loop.

A source's share then means whole repetitions of all its documents and one
partial one: documents in the order of a seeded hash until the rest is
reached.  The running sum goes over buckets of the hash first; only the one
bucket in which the rest runs out is ordered by document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import VOCABULARY, bpe_tokens
from ..sources.tables import salted, spread, written

IN_BUCKET = 50_000  # documents of a source that one bucket of the hash holds, about
SMALL = 100_000  # rows of mix_targets up to which they are broadcast


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, n_tokens) of all documents with text."""

    some = documents.select("doc_id", "source", "text").where(F.col("text").rlike(r"\S"))
    return spread(some, "doc_id").select("doc_id", "source", bpe_tokens(F.col("text"), vocabulary, approximate=False).alias("n_tokens"))


def allotments(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Tokens that each source gives to each mix.

    ``sizes``: (source, tokens), every source with text, null among them.
    Columns: mix_id, source, target_share, max_repeats, tokens, wanted (size
    of the mix), allotted.  A source without documents gives nothing; if all
    sources of a mix are full, the mix stays smaller than wanted.  Null or
    negative shares count as zero, null max_repeats as one.
    """
    total = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    t = targets.select("mix_id", "source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"), "size_ratio")
    t = t.join(sizes, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).join(F.broadcast(total))
    t = t.withColumn("wanted", F.col("total") * F.coalesce("size_ratio", F.lit(1.0))).withColumn("cap", (F.col("tokens") * F.col("max_repeats")).cast("double"))
    live = (F.col("target_share") > 0) & (F.col("cap") > 0)
    t = t.withColumn("full_at", F.when(live, F.col("cap") / F.col("target_share")))  # level at which the source is full
    order = Window.partitionBy("mix_id").orderBy(F.col("full_at").asc_nulls_last(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("_caps", F.coalesce(F.sum(F.when(live, F.col("cap"))).over(before), F.lit(0.0)))
    t = t.withColumn("_weights", F.sum(F.when(live, F.col("target_share"))).over(rest))
    # The level if all sources before this one are full; the first level below its own source's counts.
    t = t.withColumn("_level", F.when(live, (F.col("wanted") - F.col("_caps")) / F.col("_weights")))
    fits = F.when(F.col("_level") <= F.col("full_at"), F.col("_level"))
    t = t.withColumn("_at", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    gives = F.when(live, F.least("cap", F.coalesce(F.col("_at") * F.col("target_share"), F.col("cap")))).otherwise(0.0)
    return t.select("mix_id", "source", "target_share", "max_repeats", "tokens", "wanted", F.greatest(gives, F.lit(0.0)).alias("allotted"))


def chosen(counts: DataFrame, targets: DataFrame, seed: int = 7) -> DataFrame:
    """(mix_id, source, doc_id, n_tokens, repeats): the documents of each mix.

    ``counts`` comes from :func:`token_counts`, written, as it is read three
    times.  No document is repeated more than max_repeats times; the choice
    depends on the seed and the ids only.
    """
    sizes = counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    plan = allotments(sizes, targets).where("allotted > 0").join(sizes.select("source", "docs"), "source")
    # A source has as many buckets as keep each small, so the one that is ordered does not grow with it.
    plan = plan.withColumn("_buckets", F.greatest(F.lit(64), F.ceil(F.col("docs") / IN_BUCKET) * 16).cast("long"))
    plan = plan.withColumn("_whole", F.floor(F.col("allotted") / F.col("tokens") + 1e-9)).withColumn("_rest", F.greatest(F.col("allotted") - F.col("_whole") * F.col("tokens"), F.lit(0.0)))
    plan = written(plan, "p7-plan")  # a row a mix and source; read four times
    few = plan.count() <= SMALL
    # Beyond that, a source that holds a third of all documents is spread over salts.
    joined = counts.join(F.broadcast(plan), "source") if few else salted(counts, plan, ["source"], ["doc_id"])
    joined = joined.withColumn("_h", F.xxhash64(F.lit(seed), "mix_id", "doc_id")).withColumn("_bucket", F.pmod(F.col("_h"), F.col("_buckets")))
    buckets = joined.groupBy("mix_id", "source", "_bucket").agg(F.sum("n_tokens").alias("_n"), F.first("_rest").alias("_r"))
    upto = Window.partitionBy("mix_id", "source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    # Buckets before the one in which the rest runs out are taken whole.
    edge = buckets.where((F.col("_before") < F.col("_r")) & (F.col("_before") + F.col("_n") > F.col("_r"))).select("mix_id", "source", F.col("_bucket").alias("_edge"), "_before")
    last = buckets.where(F.col("_before") + F.col("_n") <= F.col("_r")).groupBy("mix_id", "source").agg(F.max("_bucket").alias("_last"))
    cuts = plan.select("mix_id", "source").join(edge, ["mix_id", "source"], "left").join(last, ["mix_id", "source"], "left")
    joined = joined.join(F.broadcast(cuts), ["mix_id", "source"]) if few else salted(joined, cuts, ["mix_id", "source"], ["doc_id"])
    inside = joined.where(F.col("_bucket") == F.col("_edge"))
    running = F.sum("n_tokens").over(Window.partitionBy("mix_id", "source").orderBy("_h", "doc_id"))
    picked = inside.withColumn("_sum", running).where(F.col("_before") + F.col("_sum") - F.col("n_tokens") / 2 <= F.col("_rest")).select("mix_id", "source", "doc_id", F.lit(1).alias("_one"))
    outside = joined.where(F.col("_edge").isNull() | (F.col("_bucket") != F.col("_edge"))).withColumn("_one", F.coalesce((F.col("_bucket") <= F.col("_last")).cast("int"), F.lit(0)))
    on_edge = inside.join(picked, ["mix_id", "source", "doc_id"], "left").withColumn("_one", F.coalesce("_one", F.lit(0)))
    both = outside.select("mix_id", "source", "doc_id", "n_tokens", "_whole", "_one", "max_repeats").unionByName(on_edge.select("mix_id", "source", "doc_id", "n_tokens", "_whole", "_one", "max_repeats"))
    return both.withColumn("repeats", F.least(F.col("_whole") + F.col("_one"), F.col("max_repeats")).cast("int")).where("repeats > 0").select("mix_id", "source", "doc_id", "n_tokens", "repeats")


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 7) -> DataFrame:
    """(mix_id, doc_id, repeats) of every mix.  Null and blank texts are never chosen."""
    counts = written(token_counts(documents, vocabulary), "p7-tokens")
    return chosen(counts, targets, seed).select("mix_id", "doc_id", "repeats")


def shares(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, seed: int = 7) -> DataFrame:
    """Per mix and source: target and reached share, documents, tokens with repeats, and tokens wanted of the mix."""
    counts = written(token_counts(documents, vocabulary), "p7-tokens")
    got = chosen(counts, targets, seed).groupBy("mix_id", "source").agg(F.count("*").alias("n_docs"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_repeats"))
    sizes = counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    plan = allotments(sizes, targets).select("mix_id", "source", "target_share", "max_repeats", F.round("wanted").cast("long").alias("mix_tokens_wanted"), F.round("allotted").cast("long").alias("tokens_allotted"))
    out = plan.join(got, ["mix_id", "source"], "left").fillna(0, ["n_docs", "n_tokens", "most_repeats"])
    whole = F.sum("n_tokens").over(Window.partitionBy("mix_id"))
    return out.withColumn("share", F.when(whole > 0, F.col("n_tokens") / whole).otherwise(0.0))
