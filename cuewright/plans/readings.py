"""Queries of alignment, voting and order-dependent segmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import align as A
from ..operators import intervals as I
from ..operators import resegment as G
from ..tables import partitioned
from . import base as B


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Three readings of each segment: its source text as the pivot, and two in which words are changed or dropped by position."""
    s = B.timed(B.segments(spark, d, "text_src")).where("text_src is not null")
    ws = T.whitespace_words(F.col("text_src"))
    seed = F.col("run_id") + F.col("idx")
    verify = F.transform(ws, lambda w, i: F.when((i + seed) % 7 == 3, F.concat(w, F.lit("x"))).when((i + seed) % 23 == 5, F.lit("")).otherwise(w))
    arbiter = F.transform(ws, lambda w, i: F.when((i + seed) % 14 == 3, F.concat(w, F.lit("x"))).when((i + seed) % 11 == 4, F.lit("other")).otherwise(w))
    join = lambda a: F.concat_ws(" ", F.filter(a, lambda w: w != ""))
    cover = I.subtitle_coverage(B.cues(spark, d), s)
    r = s.select("run_id", "idx", F.col("text_src").alias("pivot"), F.when(seed % 5 != 0, join(verify)).alias("verify"), F.when(seed % 3 != 0, join(arbiter)).alias("arbiter"), (seed % 2).alias("attempts"))
    return partitioned(r.join(cover, ["run_id", "idx"], "left"), "run_id", "idx")


def reading_comparison(spark: SparkSession, d: str) -> DataFrame:
    r = A.with_readings(readings(spark, d).where("verify is not null"))
    return r.select("run_id", "idx", F.col("_need").alias("needs_arbiter"), A.comparison("_p", "_v", "_mv").alias("c")).select("run_id", "idx", "c.*", "needs_arbiter")


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    return A.verdicts(readings(spark, d)).drop("winners", "regions")


def vote_regions(spark: SparkSession, d: str) -> DataFrame:
    return A.vote_regions(A.verdicts(readings(spark, d)))


def weight_sweep(spark: SparkSession, d: str) -> DataFrame:
    sets = spark.createDataFrame([(0, [0.2, 0.5, 0.3]), (1, [0.5, 0.5, 0.3]), (2, [0.6, 0.5, 0.3])], "set_id int, weights array<double>")
    return A.weight_sweep(readings(spark, d), sets)


def suspect_readings(spark: SparkSession, d: str) -> DataFrame:
    r = A.with_readings(readings(spark, d).where("verify is not null"))
    p, v = F.col("_p.toks"), F.col("_v.toks")
    return r.where(F.size(p) > 0).select("run_id", "idx", F.bround("_mv_align", 4).alias("align"), A.is_suspect(p, v, F.col("_mv_align")).alias("suspect"))


def pause_segments(spark: SparkSession, d: str) -> DataFrame:
    return G.pause_split(B.words(spark, d), 6_000, 300)


def word_windows(spark: SparkSession, d: str) -> DataFrame:
    return G.word_windows(B.words(spark, d), 20)


def sentence_segments(spark: SparkSession, d: str) -> DataFrame:
    return G.sentence_segments(B.words(spark, d))


def merged_windows(spark: SparkSession, d: str) -> DataFrame:
    """Segments heard by overlapping windows of two minutes, in the later window 80 ms late, merged again."""
    s = B.timed(B.segments(spark, d, "text_src"))
    win = I.window_layout(B.runs(spark, d), 120_000, 10_000).withColumnsRenamed({"start_ms": "win_start", "end_ms": "win_end"})
    a = win.select("run_id", "win_idx", F.col("win_start").alias("a_start"), F.col("win_end").alias("a_end"))
    b = s.select("run_id", "text_src", F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    both = I.overlap_pairs(a, b)
    late = F.when(F.col("win_idx") > 0, F.lit(80)).otherwise(F.lit(0))
    inside = both.select("run_id", "win_idx", F.col("a_start").alias("win_start"), F.col("a_end").alias("win_end"), F.greatest("a_start", F.col("b_start") + late).alias("start_ms"), F.least("a_end", F.col("b_end") + late).alias("end_ms"), F.col("text_src").alias("text"))
    return G.merge_windows(inside.where("end_ms > start_ms"))


QUERIES = {f.__name__: f for f in (reading_comparison, verdicts, vote_regions, weight_sweep, suspect_readings, pause_segments, word_windows, sentence_segments, merged_windows)}
_SPANS = r"""sp AS (SELECT run_id, span, list(word_idx ORDER BY word_idx) AS wi, list(start_ms ORDER BY word_idx) AS st, list(end_ms ORDER BY word_idx) AS en FROM (
SELECT *, CAST(coalesce(sum(CASE WHEN regexp_matches(word, '[.!?…]["'')\]}»”’]*$') THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS span FROM w)
WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL GROUP BY run_id, span)"""
ORACLES: dict[str, str] = {
    # A window is a step of the recursion: the first of the largest silences among the last fifth of its words.
    "word_windows": "WITH RECURSIVE " + B.W + ", " + _SPANS + """,
r AS (SELECT run_id, span, 0 AS part, 0 AS a, len(wi) AS n FROM sp UNION ALL
SELECT run_id, span, part + 1, a + 16 + CAST(list_position(g, list_max(g)) AS INT), n FROM (SELECT r.*, list_transform(range(r.a + 17, r.a + 21), lambda k: sp.st[k + 1] - sp.en[k]) AS g FROM r JOIN sp USING (run_id, span) WHERE r.a + 20 < r.n)),
e AS (SELECT *, coalesce(lead(a) OVER (PARTITION BY run_id, span ORDER BY part), n) AS b FROM r)
SELECT run_id, span, part, wi[a + 1] AS first_idx, wi[b] AS last_idx, st[a + 1] AS start_ms, en[b] AS end_ms FROM e JOIN sp USING (run_id, span)""",
    # Halves of halves: the pause nearest the middle, else the largest gap.
    "pause_segments": "WITH RECURSIVE " + B.W + ", " + _SPANS + """,
r AS (SELECT run_id, span, 1 AS a, len(wi) AS b FROM sp UNION ALL
SELECT run_id, span, unnest([a, i + 1]) AS a, unnest([i, b]) AS b FROM (SELECT r.run_id, r.span, r.a, r.b, CAST(list_min(list_transform(range(r.a, r.b), lambda k: {
'x': CASE WHEN sp.st[k + 1] - sp.en[k] >= 300 THEN 0 ELSE 1 END, 'y': CASE WHEN sp.st[k + 1] - sp.en[k] >= 300 THEN abs(sp.en[k] + sp.st[k + 1] - sp.st[r.a] - sp.en[r.b]) ELSE sp.en[k] - sp.st[k + 1] END,
'z': CASE WHEN sp.st[k + 1] - sp.en[k] >= 300 THEN 0 ELSE abs(sp.en[k] + sp.st[k + 1] - sp.st[r.a] - sp.en[r.b]) END, 'i': k})).i AS BIGINT) AS i
FROM r JOIN sp USING (run_id, span) WHERE r.a < r.b AND sp.en[r.b] - sp.st[r.a] > 6000)),
l AS (SELECT r.* FROM r JOIN sp USING (run_id, span) WHERE r.a = r.b OR sp.en[r.b] - sp.st[r.a] <= 6000)
SELECT run_id, span, CAST(row_number() OVER (PARTITION BY run_id, span ORDER BY a) - 1 AS INT) AS part, wi[a] AS first_idx, wi[b] AS last_idx, st[a] AS start_ms, en[b] AS end_ms FROM l JOIN sp USING (run_id, span)""",
}
