"""Reading the tables of a data folder, and the delivery rule shared by all of them."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOT = str(Path(__file__).resolve().parent.parent)


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Enough where executors see the same path; elsewhere ship the package with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """``folder/name.parquet``, pruned to ``columns`` (all of them when none is given)."""
    reach_workers(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores where they lie in fewer files than that; large inputs stay as they are, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def partitioned(df: DataFrame, *keys: str) -> DataFrame:
    """The rows shuffled by ``keys`` for costly work per row.

    Where the session's shuffle partitions are few for its cores, their number is kept, so that small
    but costly rows do not end in a handful of tasks; otherwise the adaptive planner sizes them.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys) if n <= 4 * spark.sparkContext.defaultParallelism else df.repartition(*keys)


def delivered_once(df: DataFrame, *keys: str, order: str = "loaded_at") -> DataFrame:
    """One row per natural key: the earliest delivery by ``order``.

    Ties on ``order`` carry the same content by contract, so any of them may stay. The rows are
    shuffled once and reduced with ``min_by`` over a struct, which never gathers a key's rows; copies
    are few, so combining them before the shuffle would cost more than it saves. Rows whose key holds a null form a key of their own, like any other value.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    rank = F.coalesce(F.col(order).cast("timestamp"), F.lit("9999-12-31").cast("timestamp")) if order in rest else F.lit(0)
    first = partitioned(df, *keys).groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("_row"))
    return first.select(*keys, "_row.*")


def finite(c: Column) -> Column:
    """Null instead of NaN or infinity."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def base_lang(c: Column) -> Column:
    """``es_419`` / ``ES-mx`` / `` es `` -> ``es``; null stays null."""
    return F.lower(F.regexp_extract(F.trim(c), "^([A-Za-z]+)", 1))
