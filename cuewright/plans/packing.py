"""Queries of packing, context, profiles and casting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import profiles as L
from ..functions import text as T
from ..operators import intervals as I
from ..operators import packing as K
from ..tables import spread, table
from . import base as B
from . import spans as SP

POOL = ["Adrian", "Maya", "Noah", "Nina"]


def source_cues(spark: SparkSession, d: str) -> DataFrame:
    return K.source_cues(B.words(spark, d), B.timed(B.segments(spark, d, "text_src")), 42, 6_000)


def target_cues(spark: SparkSession, d: str) -> DataFrame:
    s = B.timed(B.segments(spark, d, "text_target")).where("text_target is not null")
    out = K.target_cues(s, I.boundary_curve(B.words(spark, d), s), 42, 6_000)
    return out.withColumn("start_ms", F.round("start_ms", 3)).withColumn("end_ms", F.round("end_ms", 3))


def speech_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents in chunks of at most 60 syllables."""
    docs = spread(table(spark, d, "documents", "doc_id", "text"))
    c = docs.select("doc_id", F.posexplode(K.speech_chunks(F.col("text"), 60, T.syllables)).alias("chunk_no", "c"))
    return c.select("doc_id", "chunk_no", F.md5(F.col("c.t").cast("binary")).alias("digest"), F.col("c.k").alias("break_before"))


def clip_batches(spark: SparkSession, d: str) -> DataFrame:
    s = B.segments(spark, d, "text_target", "speaker").where("text_target is not null")
    return K.clip_batches(s.withColumn("units", T.syllables(F.col("text_target"))), 8, 360.0)


def context_batches(spark: SparkSession, d: str) -> DataFrame:
    s = B.segments(spark, d, "text_src", "feed").select("run_id", "idx", F.md5(F.col("text_src").cast("binary")).alias("text"), F.col("feed").alias("visual"))
    out = K.context_batches(s, 12, 2)
    return out.select("run_id", "batch", "first_idx", "last_idx", *[F.concat_ws("|", c).alias(c) for c in ("before", "after", "visuals")])


def previous_translations(spark: SparkSession, d: str) -> DataFrame:
    s = B.segments(spark, d, "text_target").select("run_id", "idx", F.md5(F.col("text_target").cast("binary")).alias("text"))
    return K.previous_translations(s, 12, 3).select("run_id", "batch", F.concat_ws("|", "previous").alias("previous"))


def run_profiles(spark: SparkSession, d: str) -> DataFrame:
    """The profile of each run's target language, its cue budget and the length budget of ten seconds."""
    r = L.resolve(table(spark, d, "runs", "run_id", "target_lang"), "target_lang", ["run_id"])
    language = F.coalesce(F.nullif(F.col("voice_language"), F.lit("")), F.lower(F.regexp_extract(F.trim("target_lang"), "^([A-Za-z]+)", 1)))
    return r.select("run_id", "locale", "length_model", "rate", L.cue_budget(F.col("length_model"), F.col("cps_max")).alias("cue_budget"), F.greatest(F.lit(3), F.floor(F.col("rate") * 10)).cast("bigint").alias("budget_10s"), language.alias("voice_language"))


def voice_cast(spark: SparkSession, d: str) -> DataFrame:
    s = B.segments(spark, d, "speaker")
    return L.cast_voices(s, POOL, "Adrian", {"A": "Grace", "B": ""})


def unknown_voices(spark: SparkSession, d: str) -> DataFrame:
    """Speaker labels that no cast member bears."""
    return L.unknown_names(table(spark, d, "segments", "speaker").where("speaker is not null"), table(spark, d, "speakers", "speaker"), "speaker")


QUERIES = {f.__name__: f for f in (source_cues, target_cues, speech_chunks, clip_batches, context_batches, previous_translations, run_profiles, voice_cast, unknown_voices)}

_CHAIN = """pr(locale, model, rate, cps, vl) AS (VALUES ('vi', 'syllable', 4.3, 21.0, 'vi'), ('en', 'cps', 15.0, 17.0, 'en'), ('fr', 'cps', 17.0, 17.0, 'fr'), ('es', 'cps', 17.0, 17.0, 'es')),
t AS (SELECT run_id, tgt FROM r)"""
_POS = "p AS (SELECT run_id, idx, {0} AS text, {1} AS visual, (row_number() OVER (PARTITION BY run_id ORDER BY idx) - 1) // 12 AS batch FROM s)"
ORACLES = {
    "source_cues": B.sql(B.W, B.S, SP._TS, "ins AS (SELECT w.run_id, idx, word_idx, w.start_ms, w.end_ms, word FROM w JOIN ts ON w.run_id = ts.run_id AND w.start_ms >= ts.start_ms AND w.start_ms < ts.end_ms)",
        "l AS (SELECT run_id, idx, list({'a': start_ms, 'b': end_ms, 'w': word} ORDER BY word_idx) AS ws FROM ins GROUP BY ALL)",
        """f AS (SELECT run_id, idx, list_reduce(list_transform(ws, lambda x: [{'a': x.a, 'b': x.b, 'w': x.w}]), lambda acc, x: CASE WHEN length(acc[-1].w) + 1 + length(x[1].w) > 42 OR x[1].b - acc[-1].a > 6000 THEN list_concat(acc, x)
ELSE list_concat(acc[1:len(acc) - 1], [{'a': acc[-1].a, 'b': x[1].b, 'w': acc[-1].w || ' ' || x[1].w}]) END) AS q FROM l)""",
        "e AS (SELECT run_id, idx, unnest(range(len(q))) AS cue_no, unnest(q) AS u FROM f)",
        r"SELECT run_id, idx, CAST(cue_no AS INT) AS cue_no, u.a AS start_ms, u.b AS end_ms, u.w AS text FROM e UNION ALL SELECT run_id, idx, 0, start_ms, end_ms, text_src FROM ts WHERE regexp_replace(text_src, '^\s+|\s+$', '', 'g') <> '' AND NOT EXISTS (SELECT 1 FROM ins WHERE ins.run_id = ts.run_id AND ins.idx = ts.idx)"),
    "context_batches": B.sql(B.S, _POS.format("md5(text_src)", "feed"),
        "n AS (SELECT *, coalesce(list(text) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), []) AS b, coalesce(list(text) OVER (PARTITION BY run_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), []) AS a FROM p)",
        "v AS (SELECT run_id, batch, visual, min(idx) AS f FROM p WHERE visual <> '' GROUP BY ALL)", "vv AS (SELECT run_id, batch, array_to_string((list(visual ORDER BY f))[1:3], '|') AS visuals FROM v GROUP BY ALL)",
        "SELECT n.run_id, CAST(n.batch AS INT) AS batch, min(idx) AS first_idx, max(idx) AS last_idx, coalesce(array_to_string(arg_min(b, idx), '|'), '') AS before, coalesce(array_to_string(arg_max(a, idx), '|'), '') AS after, coalesce(any_value(visuals), '') AS visuals FROM n LEFT JOIN vv ON n.run_id = vv.run_id AND n.batch = vv.batch GROUP BY n.run_id, n.batch"),
    "previous_translations": B.sql(B.S, _POS.format("md5(text_target)", "NULL"), "q AS (SELECT run_id, batch, min(idx) AS f FROM p GROUP BY ALL)",
        "k AS (SELECT q.run_id, q.batch, p.text, p.idx, row_number() OVER (PARTITION BY q.run_id, q.batch ORDER BY p.idx DESC) AS n FROM q JOIN p ON q.run_id = p.run_id AND p.idx < q.f AND p.text IS NOT NULL)",
        "SELECT q.run_id, CAST(q.batch AS INT) AS batch, coalesce(string_agg(text, '|' ORDER BY idx), '') AS previous FROM q LEFT JOIN k ON q.run_id = k.run_id AND q.batch = k.batch AND n <= 3 GROUP BY q.run_id, q.batch"),
    "run_profiles": B.sql(B.R, _CHAIN, """SELECT t.run_id, coalesce(locale, 'und') AS locale, coalesce(model, 'cps') AS length_model, CAST(coalesce(rate, 16.0) AS DOUBLE) AS rate, CAST(CASE WHEN model = 'syllable' THEN 84 ELSE least(84, floor(coalesce(cps, 17.0) * 6)) END AS INT) AS cue_budget,
CAST(greatest(3, floor(coalesce(rate, 16.0) * 10)) AS BIGINT) AS budget_10s, coalesce(vl, tgt) AS voice_language FROM t LEFT JOIN pr ON tgt = locale"""),
    "voice_cast": B.sql(B.S, "x AS (SELECT DISTINCT run_id, coalesce(speaker, '') AS speaker FROM s)", "k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY speaker = '', speaker) - 1 AS i FROM x)",
        "SELECT run_id, speaker, CASE WHEN speaker = '' THEN 'Adrian' WHEN speaker = 'A' THEN 'Grace' ELSE (['Adrian', 'Maya', 'Noah', 'Nina'])[i % 4 + 1] END AS voice FROM k"),
    "unknown_voices": "SELECT DISTINCT speaker FROM segments WHERE speaker IS NOT NULL AND speaker NOT IN (SELECT speaker FROM speakers)",
}
