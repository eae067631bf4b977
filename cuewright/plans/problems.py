"""Queries of the general training-data problems (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.periods import clean_intervals, merge_periods, periods_and_gaps
from ..tables import table


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name, track: clean_intervals(table(spark, d, name, "run_id", "start_s", "end_s").withColumn("track", F.lit(track)), "start_s", "end_s", ["run_id", "track"])
    return one("segments", "segment").unionByName(one("cues", "cue"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return periods_and_gaps(_intervals(spark, d), ["run_id", "track"])


def p4_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per run and track: number of periods and the time they cover."""
    periods = merge_periods(_intervals(spark, d), ["run_id", "track"])
    return periods.groupBy("run_id", "track").agg(F.count(F.lit(1)).alias("n_periods"), F.sum(F.col("to_ms") - F.col("from_ms")).alias("covered_ms"))


_PERIODS_SQL = """
WITH raw AS (
  SELECT run_id, 'segment' AS track, start_s, end_s FROM segments
  UNION ALL SELECT run_id, 'cue', start_s, end_s FROM cues),
iv AS (
  SELECT run_id, track, CAST(round(start_s * 1000) AS BIGINT) AS a, CAST(round(end_s * 1000) AS BIGINT) AS b
  FROM raw WHERE isfinite(start_s) AND isfinite(end_s)),
marked AS (
  SELECT *, max(b) OVER (PARTITION BY run_id, track ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM iv WHERE b > a),
isl AS (
  SELECT *, sum(CASE WHEN seen IS NULL OR a > seen THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, track ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g
  FROM marked),
periods AS (SELECT run_id, track, min(a) AS from_ms, max(b) AS to_ms FROM isl GROUP BY run_id, track, g)
"""

QUERIES = {"p4_found": p4_found, "p4_coverage": p4_coverage}
ORACLES = {
    "p4_found": _PERIODS_SQL
    + """, nxt AS (SELECT *, lead(from_ms) OVER (PARTITION BY run_id, track ORDER BY from_ms) AS after FROM periods)
SELECT run_id, track, 'period' AS kind, from_ms, to_ms FROM periods
UNION ALL SELECT run_id, track, 'gap', to_ms, after FROM nxt WHERE after IS NOT NULL""",
    "p4_coverage": _PERIODS_SQL + "SELECT run_id, track, count(*) AS n_periods, CAST(sum(to_ms - from_ms) AS BIGINT) AS covered_ms FROM periods GROUP BY run_id, track",
}
