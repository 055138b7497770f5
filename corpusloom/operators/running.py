"""Running numbers and sums over orders too long for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut


def running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column] | None = None, number: str = "rank_ord") -> DataFrame:
    """Add ``number`` (1, 2, ...) and running ``sums`` within ``keys``, in ``order``.

    A plain window would bring a whole group into one task.  Here the rows are
    range-partitioned by keys and order, numbered within the ranges, and the
    ranges' totals, one row per range and group, are summed before them.
    Ties are broken by the order only; give one that is total.
    """
    sums = sums or {}
    placed = cut(df.repartitionByRange(*[F.col(k) for k in keys], *order).sortWithinPartitions(*[F.col(k) for k in keys], *order).withColumn("_at", F.spark_partition_id()))
    inside = Window.partitionBy("_at", *keys).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn("_n", F.row_number().over(inside))
    for name, x in sums.items():
        local = local.withColumn(f"_s_{name}", F.sum(x).over(upto))
    totals = placed.groupBy("_at", *keys).agg(F.count("*").alias("_t"), *[F.sum(x).alias(f"_t_{name}") for name, x in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_at", *keys, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_b"), *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    out = local.join(offsets, ["_at", *keys])
    out = out.withColumn(number, (F.col("_n") + F.col("_b")).cast("long"))
    for name in sums:
        out = out.withColumn(name, F.col(f"_s_{name}") + F.col(f"_b_{name}"))
    return out.drop("_at", "_n", "_b", *[f"_s_{n}" for n in sums], *[f"_b_{n}" for n in sums])
