"""Reading the test tables and cutting lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of a data folder, with only the named columns (all if none are named)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, named by ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder is taken in local mode only; a
    cluster's executors would not share one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), f"corpusloom-{os.getuid()}")
    return at.rstrip("/")


def removed_at_end(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the application ends; results may be read until then."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)


def written(df: DataFrame, label: str = "stage", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the result survives lost executors.

    Used where a result is read more than once and computing it twice would
    cost more than writing it once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    removed_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written and read back: its lineage ends there.

    A checkpoint would do the same, but computes its rows twice.
    """
    return written(df, "cut")


def spread(df: DataFrame, *keys: str, per_core: int = 2) -> DataFrame:
    """Spread rows over the cluster's cores before Python work on them.

    A small input file is one scan partition, however many cores there are;
    hashing on a unique key gives even tasks whatever repo the rows belong to.
    """
    n = max(df.sparkSession.sparkContext.defaultParallelism * per_core, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *[F.col(k) for k in keys])


BROADCAST_BYTES = 64 << 20  # what a lookup table may take on every executor


def lookup(left: DataFrame, right: DataFrame, keys: list[str], width: int = 200, salts: int = 16, how: str = "left", salt: str | None = None) -> DataFrame:
    """Join a table with a lookup table that has at most one row per key.

    The lookup is broadcast only if its rows, counted, times ``width`` bytes
    stay within BROADCAST_BYTES; give a table that is cheap to count, as a
    written one.  Beyond that it is repeated over salts, so that a key held by
    a third of the left side is spread over as many tasks.  The salt is a hash
    of the column ``salt``, or of the whole row: a task that runs again draws
    the same salts.
    """
    if right.limit(BROADCAST_BYTES // width + 1).count() <= BROADCAST_BYTES // width:
        return left.join(F.broadcast(right), keys, how)
    by = [salt] if salt else [c for c, t in left.dtypes if "map<" not in t]
    return salted(left, right, keys, by, salts, how)


def salted(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], salts: int = 8, how: str = "inner") -> DataFrame:
    """Join with ``right``, few rows a key, repeated over salts; ``left`` draws its salt from the columns ``by``.

    A key that a third of the left side holds then meets in as many tasks as
    there are salts.  Keys without a partner cost the repetitions only.
    """
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).join(many, [*keys, "_salt"], how).drop("_salt")
