"""Queries of content keys, worker parts, settings texts and frame places, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import text as T
from ..operators import intervals as I
from ..sources import json as J
from ..tables import table
from . import base as B


def frame_places(spark: SparkSession, d: str) -> DataFrame:
    """Three frames of every segment."""
    s = B.segments(spark, d).where("start_ms is not null and end_ms is not null")
    return I.frame_times(s.select("run_id", "idx", "start_ms", "end_ms"), 3).select("run_id", "idx", "frame", F.round("at_ms", 3).alias("at_ms"))


def settings_texts(spark: SparkSession, d: str) -> DataFrame:
    """Burn style, escaped path and other target languages of every run, over heights, paths and files made from its columns."""
    r = B.runs(spark, d)
    height = (F.col("run_id") % 2000 + 100).cast("int")
    path = F.concat(F.lit("C:\\out\\"), F.coalesce("tgt", F.lit("x")), F.lit("'s [cut], v;2"))
    files = F.array(F.concat(F.lit("transcript."), F.col("tgt"), F.lit(".srt")), F.lit("transcript.pt.srt"), F.lit("transcript.fr.burn.srt"), F.lit("transcript.auto.srt"), F.lit("notes.srt"), F.lit("transcript.fr.srt"))
    others = T.other_targets(files, F.col("src"), F.col("tgt"))
    return r.select("run_id", T.burn_style(height, F.lit("Noto Sans")).alias("style"), T.filter_path(path).alias("escaped"), F.array_join(others, ",").alias("others"))


def keyword_lists(spark: SparkSession, d: str) -> DataFrame:
    """The first words of both sides of a segment as one list of at most eight terms."""
    s = B.segments(spark, d, "text_src", "text_target").where("text_src is not null")
    first = lambda c: F.slice(T.tokens(F.col(c)), 1, 6)
    return s.select("run_id", "idx", F.array_join(T.keyword_union(first("text_src"), first("text_target"), 8), " ").alias("terms"))


def first_json_values(spark: SparkSession, d: str) -> DataFrame:
    """The JSON value that opens a reply with other brackets after it."""
    e = table(spark, d, "events", "event_id", "props").where("props is not null")
    reply = F.concat(F.lit("Here: "), F.col("props"), F.lit(" and [1, {\"a\": \"]\"}] as well }"))
    quoted = F.concat(F.lit("[\"a ] \\\" b\", "), F.col("props"), F.lit("] [2]"))
    return e.select("event_id", T.embedded_json(reply).alias("json"), T.embedded_json(quoted).alias("quoted"))


def rejoined_readings(spark: SparkSession, d: str) -> DataFrame:
    """Cue texts as the parts of jobs of four."""
    c = B.cues(spark, d).select("run_id", F.floor(F.col("cue_idx") / 4).cast("int").alias("job"), (F.col("cue_idx") % 4).alias("part"), F.lit(4).alias("n_parts"), "text")
    return J.rejoined_parts(c).select("run_id", "job", F.md5("text").alias("digest"), "complete")


def dense_cues(spark: SparkSession, d: str) -> DataFrame:
    """Cues with a text, counted anew from 0."""
    return J.dense_lines(B.cues(spark, d), "run_id", "cue_idx", "text").select("run_id", "cue_idx", F.col("idx").cast("bigint").alias("idx"))


def clip_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of clips by two engines, every third with a cloned voice, and keys of the fitted texts."""
    s = B.timed(B.segments(spark, d, "text_target")).where("text_target is not null")
    engine = F.when(F.col("idx") % 2 == 0, "gemini").otherwise("higgs")
    ref = F.when(F.col("idx") % 3 == 0, F.concat(F.lit("r"), F.col("run_id").cast("string")))
    clip = K.clip_key(F.col("text_target"), engine, F.lit("p1"), F.concat(F.lit("v"), (F.col("idx") % 5).cast("string")), ref, F.lit(60), F.lit(120), F.lit(80))
    return s.select("run_id", "idx", clip.alias("clip_key"), K.converged_key(F.col("text_target"), F.col("end_ms") - F.col("start_ms"), 1.5, 2).alias("converged_key"))


def translation_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of the prompts of every run; default languages leave no trace in them."""
    return B.runs(spark, d).select("run_id", K.translation_key(F.lit("c"), F.lit("p"), F.lit("m"), F.col("src"), F.col("tgt")).alias("key"))


def stream_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return K.stream_fingerprints(B.words(spark, d))


QUERIES = {f.__name__: f for f in (frame_places, settings_texts, keyword_lists, first_json_values, rejoined_readings, dense_cues, clip_keys, translation_keys, stream_fingerprints)}
_TOKENS = "coalesce(list_slice(regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_'']+'), 1, 6), [])"
ORACLES = {
    "frame_places": B.sql(B.S, "p AS (SELECT run_id, idx, start_ms, greatest(end_ms - start_ms, 0) AS span, unnest(range(CASE WHEN end_ms - start_ms <= 1 THEN 1 ELSE 3 END)) AS frame FROM s WHERE start_ms IS NOT NULL AND end_ms IS NOT NULL)", "SELECT run_id, idx, CAST(frame AS INT) AS frame, round(start_ms + frame * span / 3.0, 3) AS at_ms FROM p"),
    "settings_texts": B.sql(B.R, """x AS (SELECT run_id, tgt, src, run_id % 2000 + 100 AS h, ['transcript.' || tgt || '.srt', 'transcript.pt.srt', 'transcript.auto.srt', 'transcript.fr.srt'] AS f FROM r)""",
        r"""SELECT run_id, 'FontName=Noto Sans,FontSize=' || CAST(greatest(18, round_even(h * 0.042, 0)) AS INT) || ',BorderStyle=1,Outline=2,Shadow=1,MarginV=' || CAST(greatest(20, round_even(h * 0.04, 0)) AS INT) AS style,
'C\:\\out\\' || coalesce(tgt, 'x') || '\''s [cut], v;2' AS escaped, CASE WHEN src IS NULL OR tgt IS NULL THEN array_to_string(list_sort(['fr', 'pt']), ',') ELSE array_to_string(list_filter(['fr', 'pt'], lambda t: t <> src AND t <> tgt), ',') END AS others FROM x"""),
    "keyword_lists": B.sql(B.S, f"l AS (SELECT run_id, idx, list_concat({_TOKENS.format('text_src')}, {_TOKENS.format('text_target')}) AS l FROM s WHERE text_src IS NOT NULL)", "SELECT run_id, idx, array_to_string(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 8), ' ') AS terms FROM l"),
    "first_json_values": r"""SELECT event_id, props AS json, '["a ] \" b", ' || props || ']' AS quoted FROM events WHERE props IS NOT NULL""",
    "rejoined_readings": B.sql(B.C, "SELECT run_id, CAST(cue_idx // 4 AS INT) AS job, md5(string_agg(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ' ' ORDER BY cue_idx)) AS digest, count(*) = 4 AS complete FROM c WHERE text IS NOT NULL GROUP BY run_id, cue_idx // 4"),
    "dense_cues": B.sql(B.C, "SELECT run_id, cue_idx, row_number() OVER (PARTITION BY run_id ORDER BY cue_idx) - 1 AS idx FROM c WHERE regexp_replace(coalesce(text, ''), '\\s', '', 'g') <> ''"),
    "clip_keys": B.sql(B.S, """x AS (SELECT run_id, idx, CAST(to_json(text_target) AS VARCHAR) AS t, end_ms - start_ms AS slot, CASE WHEN idx % 3 = 0 THEN '"ref":"r' || run_id || '"' END AS ref, CASE WHEN idx % 3 <> 0 THEN '"voice":"v' || (idx % 5) || '"' END AS voice FROM s WHERE end_ms > start_ms AND text_target IS NOT NULL)""",
        """SELECT run_id, idx, sha256('{"engine":"' || CASE WHEN idx % 2 = 0 THEN 'gemini' ELSE 'higgs' END || '","params":"p1","text":' || t || '}{' || concat_ws(',', CASE WHEN idx % 2 <> 0 THEN '"chunk_budget":60,"chunk_gap":120' END, ref, voice, CASE WHEN idx % 2 <> 0 THEN '"wrap_gap":80' END) || '}') AS clip_key,
sha256('{"rounds":2,"slot":' || slot || ',"text":' || t || ',"tolerance":1.5}{}') AS converged_key FROM x"""),
    "translation_keys": B.sql(B.R, """SELECT run_id, sha256('{"context":"c","model":"m","prompt":"p"}{' || concat_ws(',', CASE WHEN src <> 'en' THEN '"source":"' || src || '"' END, CASE WHEN tgt <> 'vi' THEN '"target":"' || tgt || '"' END) || '}') AS key FROM r"""),
    "stream_fingerprints": B.sql(B.W, """h AS (SELECT run_id, sha256('{"word_idx":' || word_idx || ',"start_ms":' || coalesce(CAST(start_ms AS VARCHAR), 'null') || ',"end_ms":' || coalesce(CAST(end_ms AS VARCHAR), 'null') || ',"word":' || coalesce(CAST(to_json(word) AS VARCHAR), 'null') || '}') AS h FROM w)""",
        "SELECT run_id, sha256(count(*) || ':' || CAST(sum(CAST('0x' || substr(h, 1, 14) AS BIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(h, 15, 14) AS BIGINT)) AS VARCHAR)) AS fingerprint FROM h GROUP BY run_id"),
}
