"""Access to tables, the shared checkpoint folder and guarded broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows up to which a side that is small by nature (limits, targets, queries) is broadcast.
BROADCAST_ROWS = 50_000


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the project's tables; parquet keeps filters and column choice at the scan."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names.

    ``spark.checkpoint.dir`` is read from the session. Where it is unset a folder of this machine is
    used if all executors run on it (a local master), else this is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors and the driver read and write."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="tabulae-")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else unchanged.

    The size is counted before the hint is given (``limit`` stops the count early), so a table
    that grew beyond the bound is joined by shuffle instead.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, how: str = "left", salts: int = 16) -> DataFrame:
    """Join a side with hot keys to a side with one row a key: the right side is repeated ``salts`` times.

    ``spread`` is any column of the left side that varies within a key.
    """
    salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")).join(salted, [*keys, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str, size: str | None = None) -> DataFrame:
    """``df`` with ``name``, the position (from 1) of each row in its group by ``order``, and, if asked, ``size``, the group's rows.

    Rows are cut into ranges of the groups and the order, numbered within each range, and shifted by
    the rows of the ranges before, which are one row a range; no task sorts a whole group. ``order``
    must tell all rows of a group apart for the numbers to be the same on every run.
    """
    keys = [F.col(c) for c in by]
    ranged = checkpoint(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    w = W.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_range").alias("__range"), before.alias("_before"), F.sum("_n").over(w).alias("_all"))
    inside = ranged.withColumn(name, F.row_number().over(W.partitionBy("_range", *by).orderBy(*order)))
    same = F.col("_range") == F.col("__range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    extra = [] if size is None else [F.col("_all").alias(size)]
    return inside.join(counts, same).select(*df.columns, (F.col(name) + F.col("_before")).cast("int").alias(name), *extra)
