"""Continuous periods and the gaps between them (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import finite

#: Intervals are first merged inside blocks of this length, so that one very large entity is spread
#: over many tasks and only its merged periods meet in one place.
BLOCK_MS = 600_000


def clean_intervals(df: DataFrame, start: str, end: str, keys: list[str]) -> DataFrame:
    """``keys`` plus ``from_ms``/``to_ms``, bounds rounded to whole milliseconds.

    Rows with a null, NaN or infinite bound, or with an end not after the start once rounded, are
    dropped. Repeated rows are harmless: merging is idempotent. Extra columns are ignored.
    """
    ms = lambda c: F.round(finite(F.col(c)) * 1000).cast("bigint")
    out = df.select(*keys, ms(start).alias("from_ms"), ms(end).alias("to_ms"))
    return out.where(F.col("from_ms").isNotNull() & F.col("to_ms").isNotNull() & (F.col("to_ms") > F.col("from_ms")))


def _sessions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Merge overlapping intervals of each key with a session window whose gap is the row's own length."""
    length = F.make_interval(secs=((F.col("to_ms") - F.col("from_ms")) / F.lit(1000)).cast("decimal(18,6)"))
    window = F.session_window(F.timestamp_millis("from_ms"), length).alias("w")
    merged = df.groupBy(*keys, window).agg(F.count(F.lit(1)).alias("_n"))
    return merged.select(*keys, F.unix_millis("w.start").alias("from_ms"), F.unix_millis("w.end").alias("to_ms"))


def merge_periods(df: DataFrame, keys: list[str], block_ms: int = BLOCK_MS) -> DataFrame:
    """One row per continuous period: ``keys, from_ms, to_ms``.

    Intervals that overlap, nest or touch (one ends on the millisecond where the next starts) form
    one period. Input columns: ``keys, from_ms, to_ms`` as from :func:`clean_intervals`. A null key
    is a key of its own; an empty input gives an empty result.

    A session window merges overlapping rows natively. It runs twice: inside blocks of ``block_ms``
    (this splits a hot key over tasks), then over the merged blocks. Touching periods that the
    window leaves apart are joined at the end over the few rows that are left.
    """
    blocks = df.withColumn("_block", F.floor(F.col("from_ms") / block_ms))
    once = _sessions(_sessions(blocks, [*keys, "_block"]).drop("_block"), keys)
    w = Window.partitionBy(*keys).orderBy("from_ms")
    # After merging, periods of a key are disjoint and sorted, so only equality with the last end remains.
    opens = F.coalesce(F.lag("to_ms").over(w) < F.col("from_ms"), F.lit(True))
    island = once.withColumn("_island", F.sum(opens.cast("int")).over(w))
    return island.groupBy(*keys, "_island").agg(F.min("from_ms").alias("from_ms"), F.max("to_ms").alias("to_ms")).drop("_island")


def periods_and_gaps(df: DataFrame, keys: list[str], block_ms: int = BLOCK_MS) -> DataFrame:
    """``keys, kind, from_ms, to_ms``: every ``period`` and every ``gap`` between consecutive ones.

    The gap of a period's right side is derived with ``lead``; both kinds come out of one pass
    over the periods. A key with a single period has no gap.
    """
    periods = merge_periods(df, keys, block_ms)
    after = F.lead("from_ms").over(Window.partitionBy(*keys).orderBy("from_ms"))
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("from_ms"), b.alias("to_ms"))
    rows = periods.withColumn("_after", after).select(
        *keys,
        F.explode(F.array(row("period", F.col("from_ms"), F.col("to_ms")), row("gap", F.col("to_ms"), F.col("_after")))).alias("_r"),
    )
    return rows.select(*keys, "_r.*").where(F.col("to_ms").isNotNull())
