"""Queries of the ledger, recomputation, reports, audio and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audio as U
from ..operators import incremental as N
from ..operators import ledger as D
from ..operators import report as Q
from ..sources import json as J
from ..sources import subtitles as X
from ..tables import table
from . import base as B
from . import readings as V


def _attempts(spark: SparkSession, d: str) -> DataFrame:
    """Events as attempts: errors and views fail, clicks are strikes, the rest succeeds; class, code and input by the value."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    v = F.floor("value").cast("bigint")
    op = F.when(F.col("event_type").isin("error", "view"), "failure").when(F.col("event_type") == "click", "strike").otherwise("ok")
    cls = F.element_at(F.array(*map(F.lit, ("infra", "content", "qa"))), (v % 3 + 1).cast("int"))
    return e.select(
        F.col("user_id").cast("bigint").alias("run_id"), F.col("event_id").cast("bigint").alias("seq"), op.alias("op"), F.format_string("seg_%04d", F.col("event_id") % 7).alias("seg_id"),
        F.lit("tts").alias("stage"), cls.alias("error_class"), F.concat(F.lit("c"), (v % 2).cast("string")).alias("code"), F.concat(F.lit("h"), F.floor(v / 250).cast("string")).alias("input_hash"))


_ATT = """att AS (SELECT CAST(user_id AS BIGINT) AS run_id, CAST(event_id AS BIGINT) AS seq, CASE WHEN event_type IN ('error', 'view') THEN 'failure' WHEN event_type = 'click' THEN 'strike' ELSE 'ok' END AS op, printf('seg_%04d', event_id % 7) AS seg_id,
'tts' AS stage, (['infra', 'content', 'qa'])[CAST(floor(value) AS BIGINT) % 3 + 1] AS cls, 'c' || (CAST(floor(value) AS BIGINT) % 2) AS code, 'h' || (CAST(floor(value) AS BIGINT) // 250) AS h FROM events)"""


def window_strikes(spark: SparkSession, d: str) -> DataFrame:
    return D.window_strikes(_attempts(spark, d))


def escalations(spark: SparkSession, d: str) -> DataFrame:
    return D.escalations(_attempts(spark, d))


def ledger_replay(spark: SparkSession, d: str) -> DataFrame:
    return D.replay(_attempts(spark, d))


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """The last status of every segment of a run, failures of hash h0 given up."""
    a = _attempts(spark, d).where("op = 'failure'")
    last = a.groupBy("run_id", "seg_id").agg(F.max_by(F.struct("input_hash", "error_class"), "seq").alias("x"))
    status = F.when(F.col("x.input_hash") == "h0", "accepted_skip").when(F.col("x.error_class") == "qa", "fit_overflow").otherwise("skipped")
    return last.select("run_id", "seg_id", F.col("x.input_hash").alias("input_hash"), status.alias("status"))


_ENT = "ent AS (SELECT run_id, seg_id, h AS input_hash, CASE WHEN h = 'h0' THEN 'accepted_skip' WHEN cls = 'qa' THEN 'fit_overflow' ELSE 'skipped' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY run_id, seg_id ORDER BY seq DESC) AS k FROM att WHERE op = 'failure') WHERE k = 1)"


def segments_to_attempt(spark: SparkSession, d: str) -> DataFrame:
    a = _attempts(spark, d).select("run_id", "seg_id", "input_hash").distinct()
    return D.to_attempt(a, _entries(spark, d))


def reconciled_overflows(spark: SparkSession, d: str) -> DataFrame:
    over = _attempts(spark, d).where("op = 'strike' and error_class = 'content'").select("run_id", "seg_id")
    return D.reconcile_overflows(_entries(spark, d), over)


def exit_codes(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    runs = table(spark, d, "events", "user_id").select(F.col("user_id").cast("bigint").alias("run_id")).distinct()
    state = F.when(F.col("run_id") % 11 == 0, "aborted").when(F.col("run_id") % 7 == 0, "failed").otherwise("completed")
    none = spark.createDataFrame([], "run_id bigint, n_replace bigint")
    return Q.run_reports(runs.withColumn("state", state), e, none).drop("n_replace")


def verdict_tallies(spark: SparkSession, d: str) -> DataFrame:
    return Q.verdict_tallies(V.verdicts(spark, d))


def winning_engines(spark: SparkSession, d: str) -> DataFrame:
    v = _voted(spark, d)
    w = Q.winners(v)
    return w.select("run_id", F.to_json("by_engine").alias("by_engine"))


def _voted(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "event_type").select(F.col("user_id").cast("bigint").alias("run_id"), "event_id", "event_type")
    return e.select("run_id", F.when(F.col("event_id") % 3 == 0, "replace").otherwise("keep").alias("decision"), F.col("event_type").alias("winners"), F.when(F.col("event_id") % 4 == 0, F.array("event_type")).otherwise(F.array().cast("array<string>")).alias("keywords"), "event_id")


def effective_keywords(spark: SparkSession, d: str) -> DataFrame:
    return Q.first_keywords(_voted(spark, d), "event_id").select("run_id", F.concat_ws("|", "keywords").alias("keywords"))


def stage_seconds(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "user_id", "event_type", "value")
    return Q.stage_seconds(e.select(F.col("user_id").cast("bigint").alias("run_id"), F.col("event_type").alias("stage"), F.col("value").alias("elapsed_s")))


def endpoint_models(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "user_id", "event_type")
    n = e.select(F.concat(F.lit("host"), (F.col("user_id") % 5).cast("string")).alias("host"), F.lit("k").alias("api_key"), F.col("event_type").alias("model"))
    return Q.endpoint_models(n).select("host", F.concat_ws("|", "models").alias("models"))


def current_segments(spark: SparkSession, d: str) -> DataFrame:
    """The stage that lists a run's segments: some runs have a translation, some only a check, the rest their recognition."""
    s = B.segments(spark, d).select("run_id", F.format_string("seg_%04d", "idx").alias("seg_id"), "idx")
    stage = lambda name, cond: s.where(cond).select("run_id", F.lit(name).alias("stage"), "seg_id")
    return Q.current_segments(stage("asr", "true").unionByName(stage("crosscheck", "run_id % 2 = 0 and idx % 3 > 0")).unionByName(stage("translate", "run_id % 3 = 0 and idx % 2 = 0")))


def _overrides(spark: SparkSession, d: str) -> DataFrame:
    """Overrides as delivered: a map per run in JSON, with a blank value, an unpadded key and a bad one."""
    r = table(spark, d, "runs", "run_id").where("run_id % 2 = 0")
    m = F.to_json(F.create_map(F.lit("seg_0001"), F.concat(F.lit("text "), F.col("run_id").cast("string")), F.lit("seg_0002"), F.lit("  "), F.lit("seg_3"), F.lit("unpadded"), F.lit("seg_9999"), F.lit("late"), F.lit("garbage"), F.lit("bad")))
    return J.overrides(r.select("run_id", m.alias("text")), "run_id")


def overridden_lines(spark: SparkSession, d: str) -> DataFrame:
    s = B.segments(spark, d, "text_src", "text_target").withColumnRenamed("text_target", "translated").withColumn("same_language", F.col("run_id") % 10 == 0)
    out = Q.apply_overrides(s, _overrides(spark, d))
    return out.withColumn("text", F.md5(F.col("text").cast("binary")))


def override_checks(spark: SparkSession, d: str) -> DataFrame:
    """Overrides with whether they apply, and whether preflight refuses their key."""
    s = B.segments(spark, d)
    valid = s.select("run_id", F.format_string("seg_%04d", "idx").alias("seg_id"))
    o = _overrides(spark, d)
    bad = Q.bad_override_keys(o, s.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))).withColumn("refused", F.lit(True))
    return Q.override_status(o, valid).join(bad, ["run_id", "seg_id"], "left").select("run_id", "seg_id", "applied", F.coalesce("refused", F.lit(False)).alias("refused"))


def preflight_problems(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "runs", "run_id", "target_lang", "duration_s")
    s = F.col("run_id").cast("string").alias("subject")
    late = r.where("duration_s is null or isnan(duration_s)").select(s, F.lit("no duration").alias("problem"))
    lang = r.where(~F.lower(F.regexp_extract(F.trim("target_lang"), "^([A-Za-z]+)", 1)).isin("vi", "en", "fr", "es")).select(s, F.lit("no profile").alias("problem"))
    return Q.problems(late, lang, lang)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    s = B.segments(spark, d, "text_target").where("text_target is not null")
    return s.select("run_id", "idx", F.sha2("text_target", 256).alias("line_key"))


def batch_plan(spark: SparkSession, d: str) -> DataFrame:
    """A rerun after every 17th line of a run was edited."""
    lines = _lines(spark, d)
    return N.batch_plan(lines, lines.where("idx % 17 <> 5"), 12)


def documents_todo(spark: SparkSession, d: str) -> DataFrame:
    """Documents to recompute, when the manifest holds four in five of them, some unfinalized or to be retried."""
    f = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    m = f.where("doc_id % 5 <> 0").withColumn("finalized", F.col("doc_id") % 13 != 0).withColumn("retryable", F.col("doc_id") % 29 == 0)
    return N.todo(f, m, ["doc_id"])


def computed_outputs(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    m = f.where("doc_id % 5 <> 0").select("doc_id", "fingerprint", F.lit(True).alias("finalized"), F.lit(None).cast("boolean").alias("retryable"), F.concat(F.lit("old "), F.col("doc_id").cast("string")).alias("output"))
    return N.load_or_compute(f, m, ["doc_id"], lambda p: p.withColumn("output", F.concat(F.lit("new "), F.col("doc_id").cast("string")))).select("doc_id", "output", "reused")


def dub_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    s = B.segments(spark, d, "text_target", "skipped")
    entry = F.when(F.col("skipped") | F.col("text_target").isNull(), F.lit("skip")).otherwise(F.sha2("text_target", 256))
    return N.ordered_fingerprint(s, ["run_id"], "idx", entry, "policy-1")


def context_chain(spark: SparkSession, d: str) -> DataFrame:
    return N.hash_chain(_lines(spark, d), "run_id", "idx", "line_key")


def clip_gates(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as clips of 64 samples a second, the label as the number of units."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    code = U.qa_code(F.col("embedding"), 64, F.col("label") + 1, F.lit(4.0), silence_db=-9.0)
    trimmed = U.trim_edges(F.col("embedding"), 0.15)
    return e.select("vec_id", F.coalesce(code, F.lit("pass")).alias("code"), F.size(trimmed).alias("n_trimmed"), U.last_loud(F.col("embedding"), 0.15).alias("last_loud"))


def faded_clips(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    f = U.clip(U.fade(U.mono(F.col("embedding"), F.reverse("embedding")), 8))
    return e.select("vec_id", F.posexplode(f).alias("i", "v")).select("vec_id", "i", (F.round("v", 6) + 0.0).alias("v"))


def mixed_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of one label laid every 48 samples over each other, every other one cut at the next onset."""
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    at = F.row_number().over(_by_label()) - 1
    c = e.select(F.col("label").cast("bigint").alias("run_id"), F.col("vec_id").alias("idx"), (at * 48).alias("at"), F.when(at % 2 == 0, F.lit(48)).alias("room"), F.transform("embedding", lambda v: v * 4).alias("samples"))
    return U.mix_timeline(c).withColumn("value", F.round("value", 5))


def _by_label():
    from pyspark.sql import Window

    return Window.partitionBy("label").orderBy("vec_id")


def split_turns(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return U.split_turns(e.select(F.col("vec_id").alias("clip_id"), F.lit(3).alias("n"), F.col("embedding").alias("samples")), 0.1, 2, 1)


def srt_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Cues rendered to one subtitle text per run and parsed again."""
    c = B.cues(spark, d).withColumn("text", T.strip(F.regexp_replace("text", r"[\s<>]+", " ")))
    r = X.render_cues(c.where("text <> '' and start_ms >= 0"), "run_id", "cue_idx")
    return X.parse_cues(r, "run_id", "srt").select("run_id", (F.col("pos") + 1).alias("cue_no"), "start_ms", "end_ms", "text")


def subtitle_choice(spark: SparkSession, d: str) -> DataFrame:
    """Sidecar and track of each run from synthetic listings."""
    r = table(spark, d, "runs", "run_id", "source_lang")
    stem = F.concat(F.lit("/v/"), F.col("run_id").cast("string"))
    ends = F.array(F.lit(".srt"), F.lit(".vtt"), F.when(F.col("run_id") % 3 == 0, F.lit(".en.vtt")), F.when(F.col("run_id") % 5 == 0, F.lit(".en.srt")), F.lit(".fr.srt"))
    files = r.select("run_id", stem.alias("stem"), F.explode(ends).alias("e")).where("e is not null").select("run_id", "stem", F.concat("stem", "e").alias("path"))
    tracks = r.select("run_id", F.posexplode(F.array(F.lit("fr"), F.when(F.col("run_id") % 2 == 0, F.lit("")).otherwise(F.lit("de")), F.when(F.col("run_id") % 4 == 0, F.lit("ENG")).otherwise(F.lit("ja")))).alias("s_index", "language"))
    return X.pick_sidecar(files).join(X.pick_track(tracks), "run_id", "full")


def worker_lines(spark: SparkSession, d: str) -> DataFrame:
    """Worker output with noise between its JSON lines."""
    e = table(spark, d, "events", "event_id", "props")
    line = F.when(F.col("event_id") % 7 == 0, F.lit("warning: {not json")).when(F.col("event_id") % 7 == 1, F.lit('{"other": 1}')).otherwise(F.col("props"))
    return J.parse_lines(e.select("event_id", line.alias("value")), "k bigint", "k")


def checked_replies(spark: SparkSession, d: str) -> DataFrame:
    """Batches of ten asked lines whose replies sometimes lack one."""
    e = table(spark, d, "events", "event_id", "event_type").withColumn("batch", F.floor(F.col("event_id") / 10)).withColumn("i", (F.col("event_id") % 10).cast("int"))
    given = e.where("event_id % 97 <> 3").groupBy("batch").agg(F.to_json(F.array_sort(F.collect_list(F.struct("i", F.col("event_type").alias("text"))))).alias("reply"))
    return J.requested_items(e.select("batch", "i"), given)


QUERIES = {f.__name__: f for f in (
    window_strikes, escalations, ledger_replay, segments_to_attempt, reconciled_overflows, exit_codes, verdict_tallies, winning_engines, effective_keywords, stage_seconds, endpoint_models, current_segments,
    overridden_lines, override_checks, preflight_problems, batch_plan, documents_todo, computed_outputs, dub_fingerprints, context_chain, clip_gates, faded_clips, mixed_timeline, split_turns,
    srt_round_trip, subtitle_choice, worker_lines, checked_replies,
)}

_SEGS = "ids AS (SELECT run_id, idx, printf('seg_%04d', idx) AS seg_id FROM s)"
_OVR = "o AS (SELECT run_id, unnest(['seg_0001', 'seg_3', 'seg_9999', 'garbage']) AS seg_id, unnest(['text ' || run_id, 'unpadded', 'late', 'bad']) AS text FROM runs WHERE run_id % 2 = 0)"
_FADE = "SELECT vec_id, CAST(i AS INT) AS i, round(greatest(-1.0, least(1.0, v)), 6) + 0.0 AS v FROM (SELECT vec_id, i, (a + b) / 2 * least(1.0, i / 8.0) * least(1.0, (63 - i) / 8.0) AS v FROM (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding) AS a, unnest(list_reverse(embedding)) AS b FROM embeddings))"
ORACLES = {
    # One attempt after the other of each segment: what the entry before it was decides.
    "escalations": "WITH RECURSIVE " + _ATT + """,
o AS (SELECT *, row_number() OVER (PARTITION BY run_id, seg_id ORDER BY seq) AS k FROM att WHERE op IN ('failure', 'ok')),
r AS (SELECT run_id, seg_id, k, seq, op, cls, h, op = 'failure' AS held, CASE WHEN op = 'failure' THEN 'skipped' END AS status, CASE WHEN op = 'failure' THEN 1 ELSE 0 END AS strikes FROM o WHERE k = 1 UNION ALL
SELECT o.run_id, o.seg_id, o.k, o.seq, o.op, o.cls, o.h, o.op = 'failure',
CASE WHEN o.op = 'failure' THEN CASE WHEN r.held AND r.h = o.h AND r.status = 'skipped' AND r.cls IN ('content', 'qa') AND o.cls IN ('content', 'qa') THEN 'accepted_skip' ELSE 'skipped' END END,
CASE WHEN o.op = 'failure' THEN CASE WHEN r.held AND r.h = o.h THEN r.strikes + 1 ELSE 1 END ELSE 0 END FROM r JOIN o ON o.run_id = r.run_id AND o.seg_id = r.seg_id AND o.k = r.k + 1)
SELECT run_id, seq, status, strikes FROM r WHERE op = 'failure'""",
    "window_strikes": B.sql(_ATT, "p AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS pos FROM att)",
        "SELECT a.run_id, a.seq, count(*) AS strikes, count(*) >= 5 AS over FROM p a JOIN p b ON a.run_id = b.run_id AND a.stage = b.stage AND a.cls = b.cls AND a.code = b.code AND b.op IN ('failure', 'strike') AND b.pos BETWEEN a.pos - 19 AND a.pos WHERE a.op IN ('failure', 'strike') GROUP BY a.run_id, a.seq"),
    "segments_to_attempt": B.sql(_ATT, _ENT, "SELECT DISTINCT run_id, seg_id, h AS input_hash FROM att WHERE NOT EXISTS (SELECT 1 FROM ent WHERE ent.status = 'accepted_skip' AND ent.run_id = att.run_id AND ent.seg_id = att.seg_id AND ent.input_hash = att.h)"),
    "reconciled_overflows": B.sql(_ATT, _ENT, "ov AS (SELECT DISTINCT run_id, seg_id FROM att WHERE op = 'strike' AND cls = 'content')",
        "SELECT run_id, seg_id, status FROM ent WHERE status <> 'fit_overflow' OR (run_id, seg_id) IN (SELECT run_id, seg_id FROM ov) UNION ALL SELECT run_id, seg_id, 'fit_overflow' FROM ov WHERE (run_id, seg_id) NOT IN (SELECT run_id, seg_id FROM ent)"),
    "exit_codes": B.sql(_ATT, _ENT, "u AS (SELECT DISTINCT run_id, CASE WHEN run_id % 11 = 0 THEN 'aborted' WHEN run_id % 7 = 0 THEN 'failed' ELSE 'completed' END AS state FROM att)",
        "n AS (SELECT u.run_id, state, count(*) FILTER (WHERE status = 'skipped') AS n_skipped, count(*) FILTER (WHERE status = 'accepted_skip') AS n_accepted_skip, count(*) FILTER (WHERE status = 'length_overflow') AS n_length_overflow, count(*) FILTER (WHERE status = 'fit_overflow') AS n_fit_overflow FROM u LEFT JOIN ent ON u.run_id = ent.run_id GROUP BY ALL)",
        "SELECT *, CASE WHEN state = 'aborted' THEN 3 WHEN state = 'failed' THEN 1 WHEN n_skipped + n_accepted_skip + n_fit_overflow > 0 THEN 2 ELSE 0 END AS exit_code FROM n"),
    "winning_engines": """WITH n AS (SELECT CAST(user_id AS BIGINT) AS run_id, event_type AS w, count(*) FILTER (WHERE event_id % 3 = 0) AS n FROM events GROUP BY ALL)
SELECT run_id, '{' || coalesce(string_agg('"' || w || '":' || n, ',' ORDER BY w) FILTER (WHERE n > 0), '') || '}' AS by_engine FROM n GROUP BY run_id""",
    "effective_keywords": "SELECT CAST(user_id AS BIGINT) AS run_id, arg_min(event_type, event_id) AS keywords FROM events WHERE event_id % 4 = 0 GROUP BY user_id",
    "stage_seconds": "SELECT CAST(user_id AS BIGINT) AS run_id, event_type AS stage, round(sum(value), 2) AS seconds FROM events GROUP BY ALL",
    "endpoint_models": "SELECT 'host' || (user_id % 5) AS host, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS models FROM events GROUP BY 1",
    "current_segments": B.sql(B.S, _SEGS, "m AS (SELECT run_id, seg_id, 2 AS k FROM ids UNION ALL SELECT run_id, seg_id, 1 FROM ids WHERE run_id % 2 = 0 AND idx % 3 > 0 UNION ALL SELECT run_id, seg_id, 0 FROM ids WHERE run_id % 3 = 0 AND idx % 2 = 0)", "SELECT DISTINCT run_id, seg_id FROM (SELECT *, min(k) OVER (PARTITION BY run_id) AS f FROM m) WHERE k = f"),
    "overridden_lines": B.sql(B.S, _SEGS, _OVR, r"t AS (SELECT s.run_id, s.idx, coalesce(o.text, CASE WHEN s.run_id % 10 = 0 THEN text_src ELSE text_target END) AS x FROM s JOIN ids ON s.run_id = ids.run_id AND s.idx = ids.idx LEFT JOIN o ON ids.run_id = o.run_id AND ids.seg_id = o.seg_id)",
        r"e AS (SELECT *, coalesce(regexp_replace(x, '^\s+|\s+$', '', 'g') = '', true) AS e FROM t)", "SELECT run_id, idx, CASE WHEN NOT e THEN md5(x) END AS text, e AS skipped, CASE WHEN e THEN 'translate_failed' ELSE '' END AS reason FROM e"),
    "override_checks": B.sql(B.S, _SEGS, _OVR, "n AS (SELECT run_id, count(*) AS n FROM s GROUP BY run_id)", r"SELECT o.run_id, o.seg_id, ids.idx IS NOT NULL AS applied, coalesce(TRY_CAST(nullif(regexp_extract(o.seg_id, '^seg_([0-9]+)$', 1), '') AS BIGINT) >= coalesce(n.n, 0), true) AS refused FROM o LEFT JOIN ids ON o.run_id = ids.run_id AND o.seg_id = ids.seg_id LEFT JOIN n ON o.run_id = n.run_id"),
    "preflight_problems": "SELECT DISTINCT CAST(run_id AS VARCHAR) AS subject, 'no duration' AS problem FROM runs WHERE duration_s IS NULL OR isnan(duration_s) UNION ALL SELECT DISTINCT CAST(run_id AS VARCHAR), 'no profile' FROM runs WHERE lower(regexp_extract(trim(target_lang), '^([A-Za-z]+)', 1)) NOT IN ('vi', 'en', 'fr', 'es')",
    "batch_plan": B.sql(B.S, "p AS (SELECT run_id, idx, CAST((row_number() OVER (PARTITION BY run_id ORDER BY idx) - 1) // 12 AS INT) AS batch, idx % 17 <> 5 AS reuse FROM s WHERE text_target IS NOT NULL)", "SELECT run_id, idx, batch, bool_and(reuse) OVER (PARTITION BY run_id, batch) AS batch_valid, reuse FROM p"),
    "documents_todo": "SELECT doc_id, sha256(text) AS fingerprint FROM documents WHERE doc_id % 5 = 0 OR doc_id % 13 = 0 OR doc_id % 29 = 0",
    "computed_outputs": "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN 'old ' ELSE 'new ' END || doc_id AS output, doc_id % 5 <> 0 AS reused FROM documents",
    "dub_fingerprints": B.sql(B.S, "SELECT run_id, sha256('policy-1' || chr(10) || string_agg(CASE WHEN skipped OR text_target IS NULL THEN 'skip' ELSE sha256(text_target) END, chr(10) ORDER BY idx)) AS fingerprint FROM s GROUP BY run_id"),
    "context_chain": B.sql("RECURSIVE " + B.S, "p AS (SELECT run_id, idx, sha256(text_target) AS h, row_number() OVER (PARTITION BY run_id ORDER BY idx) AS k FROM s WHERE text_target IS NOT NULL)",
        "ch AS (SELECT run_id, idx, k, sha256(':' || h) AS chain FROM p WHERE k = 1 UNION ALL SELECT p.run_id, p.idx, p.k, sha256(ch.chain || ':' || p.h) FROM ch JOIN p ON p.run_id = ch.run_id AND p.k = ch.k + 1)", "SELECT run_id, idx, chain FROM ch"),
    "clip_gates": """WITH e AS (SELECT vec_id, label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
a AS (SELECT vec_id, any_value(label) + 1 AS u, max(abs(v)) AS peak, min(i) FILTER (WHERE abs(v) > 0.15) AS f, max(i) FILTER (WHERE abs(v) > 0.15) AS l FROM e GROUP BY vec_id)
SELECT vec_id, CASE WHEN 1.0 < greatest(0.3, u / 4.0 * 0.3) THEN 'too_short' WHEN 1.0 > greatest(u / 4.0 * 3.0, 2.5) THEN 'too_long' WHEN peak <= pow(10.0, -9.0 / 20) THEN 'silent' ELSE 'pass' END AS code, CAST(coalesce(l - f + 1, 64) AS INT) AS n_trimmed, CAST(l AS INT) AS last_loud FROM a""",
    "faded_clips": _FADE,
    "mixed_timeline": """WITH e AS (SELECT CAST(label AS BIGINT) AS run_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings),
x AS (SELECT run_id, k, unnest(range(64)) AS i, unnest(embedding) * CAST(4 AS FLOAT) AS v FROM e)
SELECT run_id, CAST(k * 48 + i AS INT) AS sample, round(greatest(-1.0, least(1.0, sum(CAST(v AS DOUBLE)))), 5) AS value FROM x WHERE k % 2 = 1 OR i < 48 GROUP BY run_id, k * 48 + i""",
    "split_turns": """WITH e AS (SELECT vec_id, unnest(range(64)) AS i, abs(unnest(embedding)) < 0.1 AS q FROM embeddings),
g AS (SELECT *, i - sum(CASE WHEN q THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY i) AS g FROM e),
r AS (SELECT vec_id, min(i) AS a, max(i) + 1 AS b FROM g WHERE q GROUP BY vec_id, g HAVING count(*) >= 2 AND min(i) > 1 AND max(i) + 1 < 63),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY b - a DESC, a) AS k FROM r) WHERE k < 3),
c AS (SELECT vec_id, list_sort(list(CAST(round_even((a + b) / 2.0, 0) AS INT))) AS cuts FROM t GROUP BY vec_id HAVING count(*) = 2),
p AS (SELECT vec_id, unnest([0, 1, 2]) AS piece, unnest([0, cuts[1], cuts[2]]) AS a, unnest([cuts[1], cuts[2], 64]) AS b FROM c)
SELECT p.vec_id AS clip_id, piece, CAST(coalesce(min(i) FILTER (WHERE NOT q), a) AS INT) AS first, CAST(coalesce(max(i) FILTER (WHERE NOT q), b - 1) AS INT) AS last FROM p JOIN e ON p.vec_id = e.vec_id AND i >= a AND i < b GROUP BY p.vec_id, piece, a, b""",
    "srt_round_trip": B.sql(B.C, r"t AS (SELECT run_id, cue_idx, start_ms, end_ms, regexp_replace(regexp_replace(text, '[\s<>]+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM c)", "SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY cue_idx) AS INT) AS cue_no, start_ms, end_ms, text FROM t WHERE text <> '' AND end_ms > start_ms AND start_ms >= 0"),
    "subtitle_choice": "SELECT run_id, '/v/' || run_id || CASE WHEN run_id % 5 = 0 THEN '.en.srt' WHEN run_id % 3 = 0 THEN '.en.vtt' ELSE '.srt' END AS path, CASE WHEN run_id % 4 = 0 THEN 2 WHEN run_id % 2 = 0 THEN 1 END AS s_index FROM runs",
    "worker_lines": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 7 > 1 AND json_extract_string(props, '$.k') IS NOT NULL",
    "checked_replies": "SELECT CAST(event_id // 10 AS BIGINT) AS batch, CAST(event_id % 10 AS INT) AS i, CASE WHEN bool_and(event_id % 97 <> 3) OVER (PARTITION BY event_id // 10) THEN event_type END AS text FROM events",
}
