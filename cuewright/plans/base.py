"""Entities of the timed-text model from the tables of a data folder, and the same in SQL.

Times become whole milliseconds; rows delivered twice count once (their content is equal by
contract, so any aggregate of the copies gives it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import base_lang, finite, partitioned, table


def ms(c: str) -> Column:
    return F.round(finite(F.col(c)) * 1000).cast("bigint").alias(c[:-1] + "ms")


def once(df: DataFrame, *keys: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    # Copies are few: one shuffle of the rows is cheaper than sorting them on both sides of it.
    return partitioned(df, *keys).groupBy(*keys).agg(*[F.min(c).alias(c) for c in rest])


def words(spark: SparkSession, d: str) -> DataFrame:
    """``run_id, word_idx, start_ms, end_ms, word, speaker``."""
    w = table(spark, d, "words", "run_id", "word_idx", "start_s", "end_s", "word", "speaker")
    return once(w.select("run_id", "word_idx", ms("start_s"), ms("end_s"), "word", "speaker"), "run_id", "word_idx")


def segments(spark: SparkSession, d: str, *extra: str) -> DataFrame:
    """``run_id, idx, start_ms, end_ms`` and the given columns."""
    s = table(spark, d, "segments", "run_id", "idx", "start_s", "end_s", *extra)
    return once(s.select("run_id", "idx", ms("start_s"), ms("end_s"), *extra), "run_id", "idx")


def timed(df: DataFrame) -> DataFrame:
    """Rows whose span has a length."""
    return df.where(F.col("end_ms") > F.col("start_ms"))


def cues(spark: SparkSession, d: str) -> DataFrame:
    """``run_id, cue_idx, start_ms, end_ms, text``."""
    c = table(spark, d, "cues", "run_id", "cue_idx", "start_s", "end_s", "text")
    return once(c.select("run_id", "cue_idx", ms("start_s"), ms("end_s"), "text"), "run_id", "cue_idx")


def runs(spark: SparkSession, d: str) -> DataFrame:
    """``run_id, duration_ms, source_lang, target_lang`` with tags as delivered and base codes ``src``, ``tgt``."""
    r = table(spark, d, "runs", "run_id", "duration_s", "source_lang", "target_lang")
    return r.select("run_id", ms("duration_s"), "source_lang", "target_lang", base_lang(F.col("source_lang")).alias("src"), base_lang(F.col("target_lang")).alias("tgt"))


def _ms(c: str) -> str:
    return f"CAST(round(CASE WHEN isfinite({c}) THEN {c} END * 1000) AS BIGINT)"


W = f"w AS (SELECT run_id, word_idx, min({_ms('start_s')}) AS start_ms, min({_ms('end_s')}) AS end_ms, min(word) AS word, min(speaker) AS speaker FROM words GROUP BY run_id, word_idx)"
S = f"s AS (SELECT run_id, idx, min({_ms('start_s')}) AS start_ms, min({_ms('end_s')}) AS end_ms, min(text_src) AS text_src, min(text_target) AS text_target, min(speaker) AS speaker, bool_or(skipped) AS skipped, min(feed) AS feed FROM segments GROUP BY run_id, idx)"
C = f"c AS (SELECT run_id, cue_idx, min({_ms('start_s')}) AS start_ms, min({_ms('end_s')}) AS end_ms, min(text) AS text FROM cues GROUP BY run_id, cue_idx)"
R = f"r AS (SELECT run_id, {_ms('duration_s')} AS duration_ms, source_lang, target_lang, lower(regexp_extract(trim(source_lang), '^([A-Za-z]+)', 1)) AS src, lower(regexp_extract(trim(target_lang), '^([A-Za-z]+)', 1)) AS tgt FROM runs)"


def sql(*parts: str) -> str:
    """A statement: the parts before the last are common table expressions."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]
