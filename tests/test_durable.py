"""Ledger, recomputation, reports, audio, sources and streams."""

import json

from conftest import sorted_rows
from pyspark.sql import functions as F

from cuewright.operators import audio as U
from cuewright.operators import converge as C
from cuewright.operators import incremental as N
from cuewright.operators import ledger as D
from cuewright.operators import report as Q
from cuewright.sources import json as J
from cuewright.sources import subtitles as X
from cuewright.streaming import attempts as S

ATT = "run_id bigint, seq bigint, op string, seg_id string, stage string, error_class string, code string, input_hash string"


def fail(cls, seg="s1", code="x", h="h", op="failure", stage="tts"):
    return (op, seg, stage, cls, code, h)


def play(spark, *events, window=20, threshold=5):
    df = spark.createDataFrame([(1, i, *e) for i, e in enumerate(events)], ATT)
    return [(r["status"], r["aborted"]) for r in D.replay(df, window, threshold).orderBy("seq").collect()]


def test_ledger_escalation(spark):
    assert play(spark, fail("qa")) == [("skipped", False)]
    assert play(spark, fail("qa"), fail("qa")) == [("skipped", False), ("accepted_skip", False)]
    assert play(spark, fail("qa"), fail("qa"), fail("qa", h="new"))[-1][0] == "skipped"
    assert play(spark, fail("infra"), fail("infra"))[-1][0] == "skipped"
    assert [s for s, _ in play(spark, fail("infra"), fail("qa"), fail("qa"))] == ["skipped", "skipped", "accepted_skip"]
    ok = lambda stage: ("ok", "s1", stage, None, None, None)
    assert [s for s, _ in play(spark, fail("qa"), ok("crosscheck"), ok("tts"))] == ["skipped", "skipped", None]


def test_ledger_abort(spark):
    same = [fail("infra", f"s{i}") for i in range(5)]
    assert play(spark, *same)[-1][1]
    assert not any(a for _, a in play(spark, *same[:4], fail("infra", "s9", code="y")))
    win = [fail("infra", f"s{i}") for i in range(2)] + [("ok", f"k{i}", "tts", None, None, None) for i in range(5)] + [fail("infra", f"t{i}") for i in range(3)]
    assert [a for _, a in play(spark, *win, window=5, threshold=3)] == [False] * 9 + [True]
    strikes = [fail("infra", None, op="strike") for _ in range(3)]
    assert play(spark, *strikes, threshold=3) == [(None, False), (None, False), (None, True)]
    assert not play(spark, *same, fail("infra", "s0"))[-1][1]
    assert not any(a for _, a in play(spark, *[fail("length", f"s{i}", op="fit_overflow") for i in range(10)], threshold=3))


def test_escalations_match_replay(spark):
    import random

    rng = random.Random(4)
    rows = [(r, i, *((("ok", f"s{rng.randrange(3)}", "tts", None, None, None)) if rng.random() < 0.2 else fail(rng.choice(["infra", "content", "qa"]), f"s{rng.randrange(3)}", h=rng.choice("ab")))) for r in range(3) for i in range(80)]
    df = spark.createDataFrame(rows, ATT)
    fold = D.replay(df, threshold=10**6).join(df.where("op = 'failure'").select("run_id", "seq"), ["run_id", "seq"])
    assert sorted_rows(D.escalations(df).select("run_id", "seq", "status")) == sorted_rows(fold.select("run_id", "seq", "status"))


def test_reconcile_is_idempotent(spark):
    e = spark.createDataFrame([(1, "a", "fit_overflow"), (1, "b", "skipped"), (1, "c", "fit_overflow")], "run_id bigint, seg_id string, status string")
    o = spark.createDataFrame([(1, "a"), (1, "b"), (1, "d"), (1, "d")], "run_id bigint, seg_id string")
    once = D.reconcile_overflows(e, o)
    want = [(1, "a", "fit_overflow"), (1, "b", "skipped"), (1, "d", "fit_overflow")]
    assert sorted_rows(once) == want and sorted_rows(D.reconcile_overflows(once, o)) == want


def test_recompute_only_what_changed(spark):
    lines = spark.createDataFrame([(1, i, f"k{i}") for i in range(6)], "run_id bigint, idx int, line_key string")
    old = lines.withColumn("line_key", F.when(F.col("idx") == 4, "other").otherwise(F.col("line_key")))
    assert sorted_rows(N.batch_plan(lines, old, 3)) == [(1, i, i // 3, i < 3, i != 4) for i in range(6)]
    assert all(r["batch_valid"] for r in N.batch_plan(lines, lines, 3).collect())
    chain = lambda df: [r["chain"] for r in N.hash_chain(df, "run_id", "idx", "line_key").orderBy("idx").collect()]
    a, b = chain(lines), chain(old)
    assert a[:4] == b[:4] and all(x != y for x, y in zip(a[4:], b[4:]))
    seen = []

    def compute(p):
        seen.extend(r["k"] for r in p.collect())
        return p.withColumn("output", F.lit("new"))

    inputs = spark.createDataFrame([(1, "f1"), (2, "f2"), (3, "f3"), (4, "f4")], "k int, fingerprint string")
    manifest = spark.createDataFrame([(1, "f1", True, False, "old"), (2, "changed", True, False, "old"), (3, "f3", False, False, "old"), (4, "f4", True, True, "old")], "k int, fingerprint string, finalized boolean, retryable boolean, output string")
    out = sorted_rows(N.load_or_compute(inputs, manifest, ["k"], compute).select("k", "output", "reused"))
    assert out == [(1, "old", True), (2, "new", False), (3, "new", False), (4, "new", False)] and sorted(seen) == [2, 3, 4]


def test_report(spark):
    schema = "run_id bigint, decision string, source string, contested boolean, low_confidence boolean, winners string"
    v = spark.createDataFrame([(1, "replace", "vote", False, False, "verify+arbiter"), (1, "keep", "vote", None, True, None), (1, "subtitle", "subtitle", None, None, None), (1, None, None, None, None, None)], schema)
    assert sorted_rows(Q.verdict_tallies(v)) == [(1, 1, 1, 2, 0, 1, 0)]
    assert Q.winners(v).first()["by_engine"] == {"verify+arbiter": 1}
    entry = "run_id bigint, seg_id string, status string"
    runs = spark.createDataFrame([(1, "completed"), (2, "aborted"), (3, "failed"), (4, "completed"), (5, "completed"), (6, "completed")], "run_id bigint, state string")
    e = spark.createDataFrame([(1, "a", "skipped"), (2, "a", "skipped"), (4, "a", "fit_overflow"), (5, "a", "length_overflow")], entry)
    codes = dict(sorted_rows(Q.run_reports(runs, e, Q.verdict_tallies(v)).select("run_id", "exit_code")))
    assert codes == {1: 2, 2: 3, 3: 1, 4: 2, 5: 0, 6: 0}
    o = spark.createDataFrame([(1, "seg_0001"), (1, "seg_0050"), (1, "garbage"), (1, "seg_3")], "run_id bigint, seg_id string")
    n = spark.createDataFrame([(1, 10)], "run_id bigint, n bigint")
    assert sorted_rows(Q.bad_override_keys(o, n)) == [(1, "garbage"), (1, "seg_0050")]


def test_sinks(spark):
    p = spark.createDataFrame([([(None,), ("aGk=",)],), ([],), (None,)], "p array<struct<data:string>>")
    assert [r[0] and bytes(r[0]) for r in p.select(J.first_audio(F.col("p"))).collect()] == [b"hi", None, None]
    u = spark.createDataFrame([(1, 1, "B", "b", 1.0, 2.0), (1, 0, "A", "a", 0.0, 1.0)], "k int, utt_idx int, speaker string, text string, start_s double, end_s double")
    assert [x["speaker"] for x in json.loads(J.speaker_utterances(u, "k").first()["utterances"])] == ["A", "B"]
    m = N.manifest_rows(spark.createDataFrame([(1, "f", "hi"), (2, "g", None)], "k int, fingerprint string, output string"), ["k"], "asr", F.col("output").isNotNull())
    assert sorted_rows(m.select("k", "stage", "size", "finalized")) == [(1, "asr", 2, True), (2, "asr", None, False)]
    r = spark.createDataFrame([(1, "completed", 2, 0, 2), (2, "completed", 0, 0, 0)], "run_id bigint, state string, n_skipped int, n_keep int, exit_code int")
    assert [x["summary"] for x in Q.summary_lines(r).orderBy("run_id").collect()] == ["completed, exit 2: 2 skipped", "completed, exit 0"]


def test_verdict_scan_skips_decoys(spark, tmp_path):
    for name, body in {"seg_0002.json": {"decision": "replace"}, "seg_0007.json": {"decision": "keep", "extra": 1}, "seg_0050.verify.json": {"decision": "replace"}, "seg_0002.json.meta.json": {"decision": "replace"}}.items():
        (tmp_path / name).write_text(json.dumps(body))
    (tmp_path / "seg_0009.json").write_text('{"decision": "rep')
    got = J.read_artifacts(spark, str(tmp_path), "decision string, winner string", r"seg_\d+\.json")
    assert sorted_rows(got.select("file_stem", "decision")) == [("seg_0002", "replace"), ("seg_0007", "keep")]


def test_json_sources(spark):
    lines = spark.createDataFrame([('{"path": "a", "text": "x"}',), ("warming up",), ('{"other": 1}',), (None,)], "value string")
    assert sorted_rows(J.parse_lines(lines, "path string, text string", "path")) == [("a", "x")]
    body = json.dumps({"status": "done", "words": [{"start": 1234, "end": 1500, "text": "Hi", "speaker": "A"}], "utterances": None})
    r = spark.createDataFrame([(1, body)], "run_id bigint, j string").select("run_id", F.from_json("j", J.WORDS_RESPONSE).alias("r")).select("run_id", "r.*")
    assert sorted_rows(J.response_words(r, "run_id")) == [(1, 0, "Hi", 1.234, 1.5, "A")] and J.response_utterances(r, "run_id").count() == 0
    o = spark.createDataFrame([(1, '{"seg_0001": "a", "seg_0002": " "}'), (2, "torn {"), (3, None)], "run_id bigint, text string")
    assert sorted_rows(J.overrides(o, "run_id")) == [(1, "seg_0001", "a")]
    asked = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (2, 3)], "batch int, i int")
    replies = spark.createDataFrame([(0, '[{"i": 0, "text": "a"}, {"i": 1, "text": "b"}]'), (1, "no json")], "batch int, reply string")
    assert sorted_rows(J.requested_items(asked, replies)) == [(0, 0, "a"), (0, 1, "b"), (1, 2, None), (2, 3, None)]


SRT = "1\r\n00:00:01,000 --> 00:00:04,000\r\nWe <i>use</i>\r\nit.\r\n\r\n2\r\n00:00:05,000 --> 00:00:05,000\r\nnothing\r\n\r\n3\r\n00:00:06,000 --> 00:00:07,500\r\n\r\n"
VTT = "WEBVTT\n\n00:00.000 --> 00:02.000 align:start\n<c>Hello</c> <00:00:01.500>world\n\nNOTE x\n\n1:00:00.000 --> 1:00:01.000\nFoo bar\n"


def test_subtitle_parser(spark):
    t = spark.createDataFrame([(1, SRT), (2, VTT), (3, ""), (4, None)], "k int, text string")
    assert sorted_rows(X.parse_cues(t, "k").select("k", "start_ms", "end_ms", "text")) == [(1, 1000, 4000, "We use it."), (2, 0, 2000, "Hello world"), (2, 3600000, 3601000, "Foo bar")]


def test_subtitle_writer(spark, tmp_path):
    c = spark.createDataFrame([(1, 0, 1000, 1000, "gone"), (1, 1, 1000, 2000, "kept"), (1, 2, 3000, 4000, "too")], "k int, n int, start_ms bigint, end_ms bigint, text string")
    r = X.render_cues(c, "k", "n")
    assert r.first()["srt"] == "1\n00:00:01,000 --> 00:00:02,000\nkept\n\n2\n00:00:03,000 --> 00:00:04,000\ntoo\n"
    X.write_srt(r, "k", str(tmp_path / "out"))
    back = X.read_texts(spark, str(tmp_path / "out" / "k=1"))
    assert [x["text"] for x in X.parse_cues(back, "path").orderBy("start_ms").collect()] == ["kept", "too"]


def test_audio(spark):
    tone, rest = [0.5, -0.5] * 20, [0.0] * 40
    clip = tone + rest + tone + rest + tone
    c = spark.createDataFrame([(1, 3, [float(x) for x in clip]), (2, 3, [float(x) for x in tone + rest + tone]), (3, 3, [float(x) for x in [0.0] * 80 + clip])], "clip_id int, n int, samples array<float>")
    got = sorted_rows(U.split_turns(c, 0.1, 8, 2))
    assert [r for r in got if r[0] == 1] == [(1, 0, 0, 39), (1, 1, 80, 119), (1, 2, 160, 199)]
    assert not [r for r in got if r[0] == 2] and [r[2] for r in got if r[0] == 3] == [80, 160, 240]
    q = lambda n, v, units: spark.createDataFrame([([float(v)] * n if n else None, units)], "s array<float>, u int").select(U.qa_code(F.col("s"), 100, F.col("u"), F.lit(4.3))).first()[0]
    assert [q(30, 0.5, 26), q(3000, 0.5, 3), q(150, 0.0, 4), q(0, 0, 4), q(140, 0.5, 6)] == ["too_short", "too_long", "silent", "undecodable", None]
    f = spark.createDataFrame([([1.0] * 6,), ([],), ([1.0],)], "s array<double>").select(U.fade(F.col("s"), 2).alias("f"))
    assert [r["f"] for r in f.collect()] == [[0.0, 0.5, 1.0, 1.0, 0.5, 0.0], [], [1.0]]
    t = spark.createDataFrame([([0.0, 0.2, 0.0, 0.3, 0.0],), ([0.0, 0.0],)], "s array<double>")
    assert [r[0] for r in t.select(U.trim_edges(F.col("s"), 0.1)).collect()] == [[0.2, 0.0, 0.3], [0.0, 0.0]]
    m = spark.createDataFrame([(1, 0, 0, 2, [0.6, 0.6, 0.6]), (1, 1, 2, None, [0.7, 0.7]), (1, 2, 3, None, [0.7]), (1, 3, 0, None, None)], "run_id bigint, idx int, at int, room int, samples array<double>")
    assert [round(r["value"], 6) for r in U.mix_timeline(m).orderBy("sample").collect()] == [0.6, 0.6, 0.7, 1.0]


def test_rework_rounds(spark):
    df = spark.createDataFrame([(1, 10), (2, 100), (3, 1000), (4, None)], "k int, v int")
    seen = []

    def redo(rows, n):
        seen.append(n)
        return rows.withColumn("v", (F.col("v") / 10).cast("int")).drop("n_rounds")

    assert sorted_rows(C.rework(df, F.col("v") > 20, redo).select("k", "v", "n_rounds")) == [(1, 10, 0), (2, 10, 1), (3, 10, 2), (4, None, 0)] and seen == [1, 2]


def test_streams(spark, tmp_path):
    rows = [(r, i, *(fail("qa", f"s{i % 3}") if i % 4 else ("ok", f"s{i % 3}", "tts", None, None, None))) for r in range(2) for i in range(40)]
    df = spark.createDataFrame(rows, ATT).withColumn("ts", F.timestamp_seconds(F.col("seq") * 600))
    src = tmp_path / "src"
    for part in range(2):
        df.where(f"seq div 20 = {part}").coalesce(1).write.mode("append").parquet(str(src))
    ddl = ATT + ", ts timestamp"
    out = tmp_path / "out"
    for _ in range(2):  # the second run finds nothing new and writes nothing twice
        S.run_available(S.ledger_stream(S.read_stream(spark, str(src), ddl, 1)), str(out), str(tmp_path / "c1")).awaitTermination()
    assert sorted_rows(spark.read.parquet(str(out))) == sorted_rows(D.replay(df))
    S.run_available(S.failure_counts(S.read_stream(spark, str(src), ddl), "ts"), str(tmp_path / "w"), str(tmp_path / "c2")).awaitTermination()
    n = spark.read.parquet(str(tmp_path / "w")).agg(F.sum("n")).first()[0]
    assert 0 < n <= df.where("op = 'failure'").count()
    got = []
    S.upsert_available(S.read_stream(spark, str(src), ddl), lambda b, i: got.append(b.count()), str(tmp_path / "c3")).awaitTermination()
    assert sum(got) == 80
    S.run_available(S.activity_sessions(S.read_stream(spark, str(src), ddl), "ts", "5 minutes"), str(tmp_path / "s"), str(tmp_path / "c4")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).where("n > 1").count() == 0
