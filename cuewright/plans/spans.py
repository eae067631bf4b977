"""Queries of the span and interval operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import intervals as I
from ..operators import spans as P
from ..tables import table
from . import base as B

_ENDER = r"coalesce(regexp_matches(word, '[.!?…][\"'')\]}»”’]*$'), false)".replace('\\"', '"')
_SPAN = f"sp AS (SELECT *, coalesce(sum(CASE WHEN {_ENDER} THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS span FROM w)"
_SPANS = "spans AS (SELECT run_id, CAST(span AS BIGINT) AS span, min(word_idx) AS first_idx, max(word_idx) AS last_idx, min(start_ms) AS start_ms, arg_max(end_ms, word_idx) AS end_ms, count(*) AS n_words FROM sp GROUP BY run_id, span)"
_SPK = "v AS (SELECT run_id, span, speaker, count(*) AS n, min(word_idx) AS f FROM sp WHERE speaker IS NOT NULL GROUP BY ALL), spk AS (SELECT run_id, CAST(span AS BIGINT) AS span, speaker, n FROM (SELECT *, row_number() OVER (PARTITION BY run_id, span ORDER BY n DESC, f, speaker DESC) AS k FROM v) WHERE k = 1)"
_MSCLOCK = "printf('%02d:%02d:%02d,%03d', greatest({0}, 0) // 3600000, (greatest({0}, 0) % 3600000) // 60000, (greatest({0}, 0) % 60000) // 1000, greatest({0}, 0) % 1000)"


def punct_spans(spark: SparkSession, d: str) -> DataFrame:
    return P.punct_spans(B.words(spark, d))


def span_speakers(spark: SparkSession, d: str) -> DataFrame:
    return P.span_speakers(B.words(spark, d))


def cue_lines(spark: SparkSession, d: str) -> DataFrame:
    """Sentence spans with their speaker, slot and formatted cue line."""
    w = B.words(spark, d)
    s = P.slots(P.punct_spans(w), "span", B.runs(spark, d)).join(P.span_speakers(w).drop("n"), ["run_id", "span"], "left")
    line = F.concat(T.clock(F.col("start_ms")), F.lit(" --> "), T.clock(F.col("end_ms")))
    return s.select("run_id", "span", "start_ms", "end_ms", "n_words", "speaker", "slot_ms", line.alias("line"))


def word_gaps(spark: SparkSession, d: str) -> DataFrame:
    return P.word_gaps(B.words(spark, d))


def best_splits(spark: SparkSession, d: str) -> DataFrame:
    return P.best_splits(B.words(spark, d), 6_000, 300)


def _tokens(w: DataFrame) -> DataFrame:
    """Words as sub-word tokens of at most four characters, with a marker and a blank after every seventh word."""
    n = F.greatest(F.lit(1), F.ceil(F.length("word") / 4)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.when(k == 0, F.lit(" ")).otherwise(F.lit("")), F.substring("word", k * 4 + 1, F.lit(4))))
    noise = F.when(F.col("word_idx") % 7 == 0, F.array(F.lit("<end>"), F.lit(" "))).otherwise(F.array().cast("array<string>"))
    t = w.where(F.length(T.strip(F.col("word"))) > 0).select("run_id", "word_idx", "start_ms", "end_ms", "speaker", F.posexplode(F.concat(pieces, noise)).alias("k", "text"))
    return t.select("run_id", (F.col("word_idx").cast("bigint") * 1000 + F.col("k")).alias("tok_idx"), "text", "start_ms", "end_ms", "speaker")


def grouped_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words cut into tokens and grouped again."""
    return P.group_tokens(_tokens(B.words(spark, d)))


def channel_language(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "channel", "lang")
    return P.majority(docs.where("channel is not null").select("channel", F.lower("lang").alias("lang")), "channel", "lang", "en")


def mark_density(spark: SparkSession, d: str) -> DataFrame:
    return P.mark_density(B.words(spark, d)).withColumn("density", F.round("density", 6))


def windowed_words(spark: SparkSession, d: str) -> DataFrame:
    """Words heard by two overlapping windows, once each."""
    w = B.words(spark, d).where("start_ms is not null")
    win = F.floor(F.col("start_ms") / 50_000).cast("int")
    late = F.col("start_ms") % 50_000 < 10_000
    twice = w.withColumn("win_idx", F.explode(F.when(late & (win > 0), F.array(win - 1, win)).otherwise(F.array(win)))).withColumn("pos", F.col("word_idx"))
    return P.dedup_windowed(twice).select("run_id", "win_idx", "word_idx", "start_ms")


def silence_runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    samples = e.select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return P.silence_runs(samples, "vec_id", "i", "v", 0.1, 2)


def cue_pieces(spark: SparkSession, d: str) -> DataFrame:
    return I.cue_pieces(B.cues(spark, d), B.segments(spark, d))


def subtitle_coverage(spark: SparkSession, d: str) -> DataFrame:
    return I.subtitle_coverage(B.cues(spark, d), B.segments(spark, d))


def words_in_segments(spark: SparkSession, d: str) -> DataFrame:
    return I.words_in_segments(B.words(spark, d), B.timed(B.segments(spark, d)))


def _shots(spark: SparkSession, d: str) -> DataFrame:
    cuts = B.cues(spark, d).where("start_ms is not null").select("run_id", F.col("start_ms").alias("cut_ms"))
    return I.shots(cuts, B.runs(spark, d), 15_000)


def run_shots(spark: SparkSession, d: str) -> DataFrame:
    return _shots(spark, d)


def segment_shots(spark: SparkSession, d: str) -> DataFrame:
    """The shot that holds the middle of each segment; the last shot holds what comes after."""
    s = B.timed(B.segments(spark, d)).withColumn("mid2", F.col("start_ms") + F.col("end_ms"))
    shots = _shots(spark, d).select("run_id", (F.col("start_ms") * 2).alias("start2"), "shot_idx")
    return I.as_of(s, shots, "mid2", "start2", "shot_idx", "idx").where("shot_idx is not null").select("run_id", "idx", "shot_idx")


def asr_windows(spark: SparkSession, d: str) -> DataFrame:
    return I.window_layout(B.runs(spark, d), 120_000, 10_000)


def clip_bounds(spark: SparkSession, d: str) -> DataFrame:
    gaps = P.word_gaps(B.words(spark, d)).where("gap_ms >= 400")
    return I.split_bounds(B.runs(spark, d), gaps)


def boundary_curve(spark: SparkSession, d: str) -> DataFrame:
    return I.boundary_curve(B.words(spark, d), B.timed(B.segments(spark, d)))


def _clips(spark: SparkSession, d: str) -> DataFrame:
    """Segments with the reading time of their translation at 15 characters a second as the clip's length."""
    s = B.timed(B.segments(spark, d, "text_target", "skipped"))
    clip = F.when(~F.col("skipped") & F.col("text_target").isNotNull(), F.floor(T.chars(F.col("text_target")) * F.lit(1000) / 15))
    return s.withColumn("clip_ms", clip.cast("bigint"))


def placed_clips(spark: SparkSession, d: str) -> DataFrame:
    return I.place_clips(_clips(spark, d), B.runs(spark, d)).where("slot_ms is not null").withColumn("tempo", F.round("tempo", 6))


def length_overflows(spark: SparkSession, d: str) -> DataFrame:
    """Clips over their segment's own length by more than the tempo cap, in runs whose lengths are counted in characters."""
    r = B.runs(spark, d).where("tgt <> 'vi'").select("run_id")
    return _clips(spark, d).join(r, "run_id", "left_semi").where(F.col("clip_ms") > (F.col("end_ms") - F.col("start_ms")) * 1.35).select("run_id", "idx", "clip_ms")


def reference_clips(spark: SparkSession, d: str) -> DataFrame:
    return I.reference_clips(B.timed(B.segments(spark, d)))


def batch_cuts(spark: SparkSession, d: str) -> DataFrame:
    """The two longest pauses inside each segment, where a clip of three turns would be cut."""
    w, s = B.words(spark, d), B.timed(B.segments(spark, d))
    gaps = P.word_gaps(w).where("gap_ms > 0").join(I.words_in_segments(w, s), ["run_id", "word_idx"]).join(s, ["run_id", "idx"])
    inside = gaps.where((F.col("middle_ms") > F.col("start_ms") + 20) & (F.col("middle_ms") < F.col("end_ms") - 20)).withColumn("n", F.lit(3))
    return I.longest_gaps(inside, ["run_id", "idx"], "n").select("run_id", "idx", "word_idx", "gap_ms")


def reading_slots(spark: SparkSession, d: str) -> DataFrame:
    """Length budget of each line from its own length, and the smaller one for a clip that ran over."""
    c = _clips(spark, d).where("clip_ms is not null")
    dur = F.col("end_ms") - F.col("start_ms")
    budget = F.greatest(F.lit(3), F.floor(dur * F.lit(17) / 1000)).cast("bigint")
    tight = F.greatest(F.lit(3), F.floor(budget * dur / F.col("clip_ms"))).cast("bigint")
    return c.select("run_id", "idx", budget.alias("budget"), tight.alias("tight_budget"))


QUERIES = {f.__name__: f for f in (
    punct_spans, span_speakers, cue_lines, word_gaps, best_splits, grouped_tokens, channel_language, mark_density, windowed_words, silence_runs, cue_pieces, subtitle_coverage,
    words_in_segments, run_shots, segment_shots, asr_windows, clip_bounds, boundary_curve, placed_clips, length_overflows, reference_clips, batch_cuts, reading_slots,
)}

_TS = "ts AS (SELECT * FROM s WHERE end_ms > start_ms)"
_TC = "tc AS (SELECT * FROM c WHERE end_ms > start_ms AND text IS NOT NULL)"
_PIECES = r"""pr AS (SELECT tc.run_id, idx, cue_idx, tc.start_ms AS cue_start, tc.end_ms AS cue_end, greatest(tc.start_ms, ts.start_ms) AS o0, least(tc.end_ms, ts.end_ms) AS o1, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS ws
FROM tc JOIN ts ON tc.run_id = ts.run_id AND tc.start_ms < ts.end_ms AND tc.end_ms > ts.start_ms),
ij AS (SELECT *, CAST(round_even((o0 - cue_start) / (cue_end - cue_start) * len(ws), 0) AS INT) AS i, CAST(round_even((o1 - cue_start) / (cue_end - cue_start) * len(ws), 0) AS INT) AS j FROM pr),
pieces AS (SELECT run_id, idx, cue_idx, cue_start, o1 - o0 AS overlap_ms, CASE WHEN j > i THEN array_to_string(ws[i + 1:j], ' ') ELSE '' END AS piece FROM ij)"""
_GAP = "g AS (SELECT run_id, word_idx, nxt - end_ms AS gap_ms, (nxt + end_ms) / 2.0 AS middle_ms FROM (SELECT *, lead(start_ms) OVER (PARTITION BY run_id ORDER BY word_idx) AS nxt FROM w) WHERE nxt IS NOT NULL AND end_ms IS NOT NULL)"
_INSIDE = "ins AS (SELECT w.run_id, idx, word_idx, w.end_ms, ts.start_ms AS s0, ts.end_ms AS s1 FROM w JOIN ts ON w.run_id = ts.run_id AND w.start_ms >= ts.start_ms AND w.start_ms < ts.end_ms)"
_CHARS = r"greatest(1, length(regexp_replace(text_target, '^\s+|\s+$', '', 'g')))"
_CLIPS = f"cl AS (SELECT *, CAST(CASE WHEN NOT skipped AND text_target IS NOT NULL THEN floor({_CHARS} * 1000 / 15.0) END AS BIGINT) AS clip_ms FROM ts)"
_SHOTS = """cut AS (SELECT r.run_id, any_value(duration_ms) AS dur, list_concat([CAST(0 AS BIGINT)], coalesce(list_sort(list(DISTINCT c.start_ms) FILTER (WHERE c.start_ms > 0 AND c.start_ms < duration_ms)), CAST([] AS BIGINT[]))) AS cuts FROM r LEFT JOIN c ON r.run_id = c.run_id WHERE duration_ms IS NOT NULL GROUP BY r.run_id),
fold AS (SELECT run_id, dur, list_reduce(list_transform(cuts, lambda x: [x]), lambda a, x: CASE WHEN x[1] - a[-1] >= 15000 THEN list_concat(a, x) ELSE a END) AS k FROM cut),
kept AS (SELECT run_id, dur, CASE WHEN len(k) > 1 AND dur - k[-1] < 15000 THEN k[1:len(k) - 1] ELSE k END AS k FROM fold),
shots AS (SELECT run_id, CAST(p AS INT) - 1 AS shot_idx, k[p] AS start_ms, coalesce(CASE WHEN p < len(k) THEN k[p + 1] END, dur) AS end_ms FROM (SELECT *, unnest(range(1, len(k) + 1)) AS p FROM kept))"""

ORACLES = {
    "punct_spans": B.sql(B.W, _SPAN, _SPANS, "SELECT * FROM spans"),
    "span_speakers": B.sql(B.W, _SPAN, _SPK, "SELECT * FROM spk"),
    "cue_lines": B.sql(B.W, B.R, _SPAN, _SPANS, _SPK, f"""SELECT a.run_id, a.span, start_ms, end_ms, n_words, speaker, coalesce(lead(start_ms) OVER (PARTITION BY a.run_id ORDER BY a.span), duration_ms) - start_ms AS slot_ms,
{_MSCLOCK.format('start_ms')} || ' --> ' || {_MSCLOCK.format('end_ms')} AS line FROM spans a LEFT JOIN r ON a.run_id = r.run_id LEFT JOIN spk b ON a.run_id = b.run_id AND a.span = b.span"""),
    "word_gaps": B.sql(B.W, _GAP, "SELECT * FROM g"),
    "best_splits": B.sql(B.W, _SPAN, "e AS (SELECT *, lead(start_ms) OVER (PARTITION BY run_id, span ORDER BY word_idx) AS nxt, min(start_ms) OVER (PARTITION BY run_id, span) AS a, max(end_ms) OVER (PARTITION BY run_id, span) AS b FROM sp)",
        "k AS (SELECT run_id, span, word_idx, nxt - end_ms AS gap, abs(nxt + end_ms - a - b) AS off FROM e WHERE b - a > 6000 AND nxt IS NOT NULL)",
        "SELECT run_id, CAST(span AS BIGINT) AS span, word_idx AS cut_idx FROM (SELECT *, row_number() OVER (PARTITION BY run_id, span ORDER BY gap >= 300 DESC, CASE WHEN gap >= 300 THEN off END, CASE WHEN gap < 300 THEN -gap END, off, word_idx) AS k FROM k) WHERE k = 1"),
    "grouped_tokens": B.sql(B.W, r"SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY word_idx) - 1 AS word_no, regexp_replace(word, '^\s+|\s+$', '', 'g') AS word, start_ms, end_ms, speaker FROM w WHERE length(regexp_replace(word, '^\s+|\s+$', '', 'g')) > 0"),
    "channel_language": """WITH n AS (SELECT channel, lower(lang) AS lang, count(*) AS n FROM documents WHERE channel IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n DESC, lang) AS k, sum(n) OVER (PARTITION BY channel) AS total, count(*) OVER (PARTITION BY channel) AS kinds FROM n WHERE lang IS NOT NULL)
SELECT a.channel, coalesce(k.lang, 'en') AS lang, k.n / k.total AS share, CASE WHEN k.n IS NULL THEN true ELSE kinds > 1 AND k.n / k.total < 0.9 END AS mixed FROM (SELECT DISTINCT channel FROM n) a LEFT JOIN k ON a.channel = k.channel AND k.k = 1""",
    "mark_density": B.sql(B.W, f"SELECT run_id, round(avg(CASE WHEN {_ENDER} THEN 1 ELSE 0 END), 6) AS density FROM w GROUP BY run_id"),
    "windowed_words": B.sql(B.W, "x AS (SELECT run_id, word_idx, start_ms, unnest(CASE WHEN start_ms % 50000 < 10000 AND start_ms >= 50000 THEN [start_ms // 50000 - 1, start_ms // 50000] ELSE [start_ms // 50000] END) AS win_idx FROM w WHERE start_ms IS NOT NULL)",
        "SELECT run_id, CAST(win_idx AS INT) AS win_idx, word_idx, start_ms FROM (SELECT *, row_number() OVER (PARTITION BY run_id, round_even(start_ms / 10.0, 0) ORDER BY win_idx, word_idx) AS k FROM x) WHERE k = 1"),
    "silence_runs": """WITH e AS (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS i FROM embeddings),
g AS (SELECT vec_id, i, abs(v) < 0.1 AS q, i - sum(CASE WHEN abs(v) < 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY i) AS k FROM e)
SELECT vec_id, CAST(min(i) AS INT) AS first, CAST(max(i) AS INT) AS last, count(*) AS n FROM g WHERE q GROUP BY vec_id, k HAVING count(*) >= 2""",
    "cue_pieces": B.sql(B.S, B.C, _TS, _TC, _PIECES, "SELECT * FROM pieces"),
    "subtitle_coverage": B.sql(B.S, B.C, _TS, _TC, _PIECES, "a AS (SELECT run_id, idx, sum(overlap_ms) AS covered, string_agg(CASE WHEN piece <> '' THEN piece END, ' ' ORDER BY cue_start, piece) AS sub_text FROM pieces GROUP BY ALL)",
        "SELECT ts.run_id, ts.idx, round(least(1.0, coalesce(covered, 0) / (end_ms - start_ms)), 4) AS coverage, coalesce(sub_text, '') AS sub_text FROM ts LEFT JOIN a ON ts.run_id = a.run_id AND ts.idx = a.idx"),
    "words_in_segments": B.sql(B.W, B.S, _TS, _INSIDE, "SELECT run_id, idx, word_idx FROM ins"),
    "run_shots": B.sql(B.R, B.C, _SHOTS, "SELECT * FROM shots"),
    "segment_shots": B.sql(B.R, B.C, B.S, _TS, _SHOTS, "SELECT ts.run_id, idx, max(shot_idx) AS shot_idx FROM ts JOIN shots ON ts.run_id = shots.run_id AND shots.start_ms * 2 <= ts.start_ms + ts.end_ms GROUP BY ts.run_id, idx"),
    "asr_windows": B.sql(B.R, "SELECT run_id, CAST(k AS INT) AS win_idx, k * 110000 AS start_ms, least(k * 110000 + 120000, duration_ms) AS end_ms FROM (SELECT *, unnest(range(0, 1 + greatest(0, CAST(ceil((duration_ms - 120000) / 110000.0) AS BIGINT)))) AS k FROM r WHERE duration_ms IS NOT NULL)"),
    "boundary_curve": B.sql(B.W, B.S, _TS, _INSIDE, "SELECT run_id, idx, CAST(row_number() OVER o AS INT) AS k, CASE WHEN lead(word_idx) OVER o IS NULL THEN s1 ELSE least(greatest(s0, max(end_ms) OVER (PARTITION BY run_id, idx ORDER BY word_idx ROWS UNBOUNDED PRECEDING)), s1) END AS bound_ms FROM ins WINDOW o AS (PARTITION BY run_id, idx ORDER BY word_idx)"),
    "placed_clips": B.sql(B.S, B.R, _TS, _CLIPS, "x AS (SELECT cl.run_id, idx, start_ms, clip_ms, lead(start_ms) OVER o IS NULL AS last, coalesce(lead(start_ms) OVER o, duration_ms) - start_ms AS slot_ms FROM cl JOIN r ON cl.run_id = r.run_id WINDOW o AS (PARTITION BY cl.run_id ORDER BY idx))",
        "y AS (SELECT *, CASE WHEN slot_ms > 0 AND clip_ms > slot_ms THEN least(clip_ms / slot_ms, 1.35) ELSE 1.0 END AS tempo FROM x WHERE slot_ms IS NOT NULL)",
        "SELECT run_id, idx, slot_ms, CASE WHEN clip_ms IS NULL THEN NULL WHEN clip_ms < slot_ms THEN start_ms + least(200.0, (slot_ms - clip_ms) / 2.0) ELSE CAST(start_ms AS DOUBLE) END AS placed_ms, round(tempo, 6) AS tempo, coalesce(slot_ms > 0 AND clip_ms > slot_ms AND clip_ms / tempo > CASE WHEN last THEN slot_ms + 1000 ELSE slot_ms * CAST(1.10 AS DOUBLE) END, false) AS overran FROM y"),
    "length_overflows": B.sql(B.S, B.R, _TS, _CLIPS, "SELECT run_id, idx, clip_ms FROM cl WHERE run_id IN (SELECT run_id FROM r WHERE tgt <> 'vi') AND clip_ms > (end_ms - start_ms) * CAST(1.35 AS DOUBLE)"),
    "reference_clips": B.sql(B.S, _TS, "b AS (SELECT *, end_ms - start_ms AS d, CASE WHEN end_ms - start_ms BETWEEN 3000 AND 12000 THEN 0 WHEN end_ms - start_ms BETWEEN 1500 AND 20000 THEN 1 END AS band FROM ts)",
        "SELECT run_id, idx, start_ms, least(end_ms, start_ms + 12000) AS clip_end_ms FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY band, d DESC, idx) AS k FROM b WHERE band IS NOT NULL) WHERE k = 1"),
    "batch_cuts": B.sql(B.W, B.S, _TS, _GAP, _INSIDE, "x AS (SELECT g.run_id, idx, g.word_idx, gap_ms FROM g JOIN ins ON g.run_id = ins.run_id AND g.word_idx = ins.word_idx WHERE gap_ms > 0 AND middle_ms > s0 + 20 AND middle_ms < s1 - 20)",
        "SELECT run_id, idx, word_idx, gap_ms FROM (SELECT *, row_number() OVER (PARTITION BY run_id, idx ORDER BY gap_ms DESC, word_idx) AS k, count(*) OVER (PARTITION BY run_id, idx) AS n FROM x) WHERE k < 3 AND n >= 2"),
    "reading_slots": B.sql(B.S, _TS, _CLIPS, "b AS (SELECT run_id, idx, end_ms - start_ms AS dur, clip_ms, CAST(greatest(3, floor((end_ms - start_ms) * 17 / 1000.0)) AS BIGINT) AS budget FROM cl WHERE clip_ms IS NOT NULL)",
        "SELECT run_id, idx, budget, CAST(greatest(3, floor(budget * dur / clip_ms)) AS BIGINT) AS tight_budget FROM b"),
}
