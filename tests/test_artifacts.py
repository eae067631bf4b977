"""Keys, worker output, run reports and texts of settings: literal cases, nulls and empty tables."""

import pytest
from conftest import sorted_rows
from pyspark.sql import functions as F

from cuewright.functions import keys as K
from cuewright.functions import text as T
from cuewright.operators import intervals as I
from cuewright.operators import ledger as D
from cuewright.operators import report as Q
from cuewright.sources import json as J
from cuewright.sources import subtitles as X

RESPONSE = "run_id bigint, " + J.WORDS_RESPONSE


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_first_json_value(spark):
    cases = [
        ('so {"a": [1, 2]} and {"b": 3}', '{"a": [1, 2]}'), ('```json\n[1, {"x": "]"}] tail\n``` [9]', '[1, {"x": "]"}]'), (r'["\"]", 1] ]', r'["\"]", 1]'), ("[1, [2]", None), ("none", None), ("", None), (None, None),
    ]
    for text, want in cases:
        assert one(spark, text, T.embedded_json) == want, text


def test_strict_clock(spark):
    assert one(spark, "00:00:01.500", T.strict_clock) == 1500 and one(spark, None, T.strict_clock) is None
    with pytest.raises(Exception, match="no subtitle time"):
        one(spark, "1:2,3", T.strict_clock)


def test_settings(spark):
    assert one(spark, "a:b'c\\d[e],f", T.filter_path) == "a\\:b\\'c\\\\d[e],f"
    assert one(spark, 100, lambda h: T.burn_style(h, F.lit("X")), "int").startswith("FontName=X,FontSize=18,") and "FontSize=45," in one(spark, 1080, lambda h: T.burn_style(h, F.lit("X")), "int")
    assert one(spark, ["b", "a", "b"], lambda x: T.keyword_union(x, F.array(F.lit("c"), F.lit("a")), 3), "array<string>") == ["b", "a", "c"] and one(spark, None, lambda x: T.keyword_union(x, x, 3), "array<string>") == []
    files = ["transcript.en.srt", "transcript.FR.srt", "transcript.de.burn.srt", "transcript.it.srt", "x.srt"]
    assert one(spark, files, lambda f: T.other_targets(f, F.lit("EN"), F.lit("it")), "array<string>") == ["FR"]
    ctx = lambda terms, text, most=20: one(spark, terms, lambda t: T.recognition_context(t, F.lit(text), most), "array<string>")
    assert ctx(["a", ""], " b ") == (["a"], "b") and ctx(None, "  ") is None and ctx([], "x") == (None, "x")
    with pytest.raises(Exception, match="over 20 characters"):
        ctx(["a" * 15], "b" * 6)
    assert one(spark, bytearray(b"abc"), lambda b: T.inline_part(b, 3), "binary") == "YWJj" and one(spark, bytearray(b"abcd"), lambda b: T.inline_part(b, 3), "binary") is None


def test_engines():
    assert K.engine("gemini") == "gemini" and K.engine("local", "asr") == "local"
    with pytest.raises(K.UnknownEngine, match="unknown tts engine 'local'; known: gemini, higgs, soniox, vieneu"):
        K.engine("local")


def test_keys_change_with_what_matters_only(spark):
    def clip(engine="higgs", voice="v", ref=None, budget=60):
        return F.max(K.clip_key(F.lit("t"), F.lit(engine), F.lit("p"), F.lit(voice), F.lit(ref).cast("string"), F.lit(budget), F.lit(1), F.lit(2)))

    forms = [clip(), clip(budget=61), clip("gemini"), clip("gemini", budget=61), clip(voice="w"), clip(ref="r"), clip(voice="w", ref="r")]
    k = spark.range(1).agg(*[f.alias(f"k{i}") for i, f in enumerate(forms)]).first()
    assert k[0] != k[1] and k[2] == k[3] and k[0] != k[4] and k[5] == k[6] and len({k[0], k[1], k[2], k[4], k[5]}) == 5
    verdict = lambda sha: K.verdict_key(F.lit("a"), F.lit(1), F.lit(2), F.lit("p"), F.lit(sha).cast("string"), F.lit(None).cast("string"), F.lit("s"))
    mux = lambda style: K.mux_key(F.lit("d"), F.lit("v"), F.lit("s"), F.lit("x"), F.lit(style).cast("string"))
    r = spark.range(1).select(verdict("x"), verdict(None), verdict("y"), mux(None), mux("s")).first()
    assert len(set(r)) == 5


def test_stream_fingerprints(spark):
    schema = "run_id bigint, word_idx int, start_ms bigint, end_ms bigint, word string"
    rows = [(1, 0, 0, 9, "a"), (1, 1, 9, None, None), (2, 0, 9, 9, "a"), (2, 1, 0, 9, "b"), (3, 1, 9, None, None), (3, 0, 0, 9, "a")]
    got = {r[0]: r[1] for r in K.stream_fingerprints(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == got[3] != got[2] and K.stream_fingerprints(spark.createDataFrame([], schema)).count() == 0
    now = spark.createDataFrame(list(got.items()), "run_id bigint, fingerprint string")
    assert sorted_rows(Q.changed_runs(now, now.where("run_id <> 2"))) == [(2,)]


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    hashes, stamps = K.file_hashes(spark, str(tmp_path)), K.file_stamps(spark, str(tmp_path))
    assert [r[1:] for r in hashes.collect()] == [(3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad")]
    known = stamps.join(hashes.drop("size"), "path")
    assert K.cached_hashes(stamps, known).first()["sha256"] and K.cached_hashes(stamps.withColumn("size", F.lit(4)), known).first()["sha256"] is None


def test_response_segments(spark):
    w = lambda *ts: [(i * 1000, i * 1000 + 500, t, None) for i, t in enumerate(ts)]
    rows = [
        (1, "ok", "t", w("a"), [(0, 1500, " Hello. ", "A"), (1500, 1600, " ", "B"), (2000, 2500, "Bye.", None)]), (2, "ok", "t", w("One", "two.", "Three"), None), (3, "ok", " all of it ", w("x", "y"), [(0, 1, "  ", "A")]), (4, "ok", None, None, []),
    ]
    got = sorted(tuple(r) for r in J.response_segments(spark.createDataFrame(rows, RESPONSE)).collect())
    assert got == [(1, 0, 0.0, 1.5, "Hello.", "A"), (1, 1, 2.0, 2.5, "Bye.", ""), (2, 0, 0.0, 1.5, "One two.", ""), (2, 1, 2.0, 2.5, "Three", ""), (3, 0, 0.0, 1.5, "all of it", "")]
    tokens = spark.createDataFrame([(1, [("a", 0, 5, "A", "en")]), (2, None)], "run_id bigint, " + J.TOKENS_RESPONSE)
    assert sorted_rows(J.response_tokens(tokens, "run_id")) == [(1, 0, "a", 0, 5, "A")]


def test_windows_parts_and_shape(spark):
    out = spark.createDataFrame([(1, 1, [(0.5, 1.0, "w")]), (1, 2, None)], "run_id bigint, win_idx int, words array<struct<start:double,end:double,word:string>>")
    win = spark.createDataFrame([(1, 1, 1000), (1, 2, 2000)], "run_id bigint, win_idx int, start_ms bigint")
    assert sorted_rows(J.window_words(out, win)) == [(1, 1, 0, 1500, 2000, "w")]
    parts = spark.createDataFrame([(1, 0, 1, 2, " b"), (1, 0, 0, 2, "a "), (1, 0, 0, 2, "a "), (1, 1, 0, 2, "x"), (1, 2, 0, 1, None)], "run_id bigint, job int, part int, n_parts int, text string")
    assert sorted_rows(J.rejoined_parts(parts)) == [(1, 0, "a b", True), (1, 1, "x", False)]
    assert J.conform(parts, "job string, gone double").columns == ["job", "gone"] and J.conform(parts, "job string, gone double").where("gone is null").count() == 5
    shots = spark.createDataFrame([(1, 0, 900), (2, 5, 5), (3, 9, 1)], "run_id bigint, start_ms bigint, end_ms bigint")
    assert [(r["run_id"], r["at_ms"]) for r in I.frame_times(shots, 3).orderBy("run_id", "frame").collect()] == [(1, 0.0), (1, 300.0), (1, 600.0), (2, 5.0), (3, 9.0)]


def test_wrapped_texts(spark):
    words = spark.createDataFrame([(1, i, i * 500, i * 500 + 400, w, None) for i, w in enumerate("one two three four".split())], "run_id bigint, word_idx int, start_ms bigint, end_ms bigint, word string, speaker string")
    segs = spark.createDataFrame([(1, 0, 0, 2000, "one two three four", "eins zwei drei vier")], "run_id bigint, idx int, start_ms bigint, end_ms bigint, text_src string, text_target string")
    source = X.wrapped_srt(words, segs, "source", 9, 6000).first()["srt"]
    assert source == "1\n00:00:00,000 --> 00:00:00,900\none two\n\n2\n00:00:01,000 --> 00:00:01,400\nthree\n\n3\n00:00:01,500 --> 00:00:01,900\nfour\n"
    target = X.wrapped_srt(words, segs, "target", 9, 6000).first()["srt"]
    assert "eins zwei" in target and "drei vier" in target and target.startswith("1\n00:00:00,000") and target.count("-->") == 2


def test_full_report(spark):
    runs = spark.createDataFrame([(1, "completed", None, ("vi", "en")), (2, "aborted", "c", ("vi", "en"))], "run_id bigint, state string, abort string, config struct<target:string,source:string>")
    entries = spark.createDataFrame([(1, "seg_0001", "skipped"), (1, "seg_0009", "accepted_skip"), (1, "seg_0002", "length_overflow"), (2, "seg_0005", "fit_overflow")], "run_id bigint, seg_id string, status string")
    verdicts = spark.createDataFrame([(1, "seg_0001", "replace", "vote", True, False, "verify"), (1, "seg_0009", "replace", "vote", False, True, "verify"), (1, "seg_0002", "keep", "none", False, True, "")], "run_id bigint, seg_id string, decision string, source string, contested boolean, low_confidence boolean, winners string")
    current = spark.createDataFrame([(1, "seg_0001"), (1, "seg_0002")], "run_id bigint, seg_id string")
    overrides = spark.createDataFrame([(1, "seg_0002"), (1, "seg_0077"), (2, "seg_0001")], "run_id bigint, seg_id string")
    timings = spark.createDataFrame([(1, "asr", 1.234), (1, "asr", 1.0)], "run_id bigint, stage string, elapsed_s double")
    marks = Q.detection_marks(spark.createDataFrame([(1, "en", True), (2, "en", False)], "run_id bigint, lang string, mixed boolean"))
    a, b = Q.full_reports(runs, entries, verdicts, current, overrides, timings, marks).orderBy("run_id").collect()
    # Segments that are no longer current count nowhere; a run without current ones keeps all.
    assert a["skipped"] == ["seg_0001"] and a["accepted_skips"] == [] and a["length_overflows"] == ["seg_0002"] and a["replacements"] == ["seg_0001"] and a["low_confidence"] == ["seg_0002"] and a["by_engine"] == {"verify": 1}
    assert a["overrides_applied"] == ["seg_0002"] and a["overrides_unmatched"] == ["seg_0077"] and a["timings"] == [("asr", 2.23)] and a["degraded"] == [("asr", "detected en")] and a["exit_code"] == 2 and a["config"]["target"] == "vi"
    assert b["fit_overflows"] == ["seg_0005"] and b["overrides_applied"] == ["seg_0001"] and b["exit_code"] == 3 and b["abort"] == "c" and b["degraded"] == [] and b["by_engine"] == {}


def test_entries_of_other_runs_stay(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = lambda *r: spark.createDataFrame(list(r), "run_id bigint, seg_id string, status string")
    D.save_entries(rows((1, "a", "skipped"), (2, "a", "skipped")), path)
    D.save_entries(rows((2, "b", "accepted_skip")), path)
    assert sorted((r["run_id"], r["seg_id"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "b")]


def test_success_of_another_stage_clears_nothing(spark):
    rows = [(1, 1, "failure", "s", "tts", "content", "c", "h"), (1, 2, "ok", "s", "fit", None, None, None), (1, 3, "failure", "s", "tts", "content", "c", "h"), (2, 1, "failure", "s", "tts", "content", "c", "h"), (2, 2, "ok", "s", "tts", None, None, None), (2, 3, "failure", "s", "tts", "content", "c", "h")]
    df = spark.createDataFrame(rows, "run_id bigint, seq bigint, op string, seg_id string, stage string, error_class string, code string, input_hash string")
    assert sorted_rows(D.escalations(df)) == [(1, 1, "skipped", 1), (1, 3, "accepted_skip", 2), (2, 1, "skipped", 1), (2, 3, "skipped", 1)]
    replayed = {(r["run_id"], r["seq"]): r["status"] for r in D.replay(df).collect()}
    assert replayed[1, 3] == "accepted_skip" and replayed[2, 3] == "skipped"
