"""Spans, periods and interval relations: literal cases and edges."""

import random

from conftest import sorted_rows

from cuewright.operators import intervals as I
from cuewright.operators import periods as P
from cuewright.operators import spans as S

WORDS = "run_id bigint, word_idx int, start_ms bigint, end_ms bigint, word string, speaker string"


def test_periods_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(0, 60_000) / 10, None) for k in (1, 2) for _ in range(300)]
    rows = [(k, a, a + rng.choice([-1, 0, 0.5, 2, 30])) for k, a, _ in rows] + [(3, None, 1.0), (3, 1.0, None), (3, float("nan"), 2.0), (None, 1.0, 2.0), (4, 1.0, 2.0), (4, 2.0, 3.0), (4, 1.2, 1.4), (4, 3.001, 4.0)] * 2
    df = spark.createDataFrame([(k, a, b, "x") for k, a, b in rows], "k bigint, start double, end double, from_ms string")
    got = sorted_rows(P.periods_and_gaps(P.clean_intervals(df, "start", "end", ["k"]), ["k"], block_ms=5_000))
    want = []
    for k in {r[0] for r in rows}:
        spans = sorted((round(a * 1000), round(b * 1000)) for q, a, b in rows if q == k and a is not None and b is not None and a == a and round(b * 1000) > round(a * 1000))
        merged: list[list[int]] = []
        for a, b in spans:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        want += [(k, "period", a, b) for a, b in merged] + [(k, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:])]
    assert got == sorted(want, key=repr)


def test_periods_empty(spark):
    df = spark.createDataFrame([], "k bigint, start double, end double")
    assert P.periods_and_gaps(P.clean_intervals(df, "start", "end", ["k"]), ["k"]).count() == 0


def test_punct_spans_and_speakers(spark):
    data = [(1, 0, 0, 400, "Hello", "A"), (1, 1, 500, 900, "world.", "A"), (1, 2, 1000, 1400, "How", "B"), (1, 3, 1500, 1900, "are", "B"), (1, 4, 2000, 2400, "you?", "B"), (2, 0, 0, 1, None, None)]
    w = spark.createDataFrame(data, WORDS)
    assert sorted_rows(S.punct_spans(w).select("run_id", "span", "first_idx", "last_idx")) == [(1, 0, 0, 1), (1, 1, 2, 4), (2, 0, 0, 0)]
    assert sorted_rows(S.span_speakers(w).select("run_id", "span", "speaker")) == [(1, 0, "A"), (1, 1, "B")]
    tie = spark.createDataFrame([(1, 0, 0, 1, "a", "B"), (1, 1, 1, 2, "b", "A")], WORDS)
    assert S.span_speakers(tie).first()["speaker"] == "B"


def test_group_tokens(spark):
    schema = "run_id bigint, tok_idx bigint, text string, start_ms bigint, end_ms bigint, speaker string"
    t = lambda *x: spark.createDataFrame([(1, i, s, a, b, sp) for i, (s, a, b, sp) in enumerate(x)], schema)
    words = lambda df: [(r["word"], r["start_ms"], r["end_ms"], r["speaker"]) for r in S.group_tokens(df).orderBy("word_no").collect()]
    assert words(t(("Beau", 1000, 1200, "1"), ("ti", 1200, 1350, "1"), ("ful", 1350, 1600, "1"))) == [("Beautiful", 1000, 1600, "1")]
    assert [w[0] for w in words(t(("Hi", 0, 1, "1"), ("there", 1, 2, "1"), (" you", 2, 3, "2")))] == ["Hithere", "you"]
    assert [w[0] for w in words(t(("Hi", 0, 1, None), (" ", 1, 2, None), ("", 2, 3, None), (" there", 3, 4, None), ("<end>", 4, 5, None)))] == ["Hi", "there"]
    try:
        words(t(*[(f"x{i}", i, i + 1, None) for i in range(20)]))
    except Exception as e:  # noqa: BLE001
        assert "word starts" in str(e)
    else:
        raise AssertionError("tokens without word starts must be refused")


def _runs(spark, *durations):
    return spark.createDataFrame([(i, d) for i, d in enumerate(durations)], "run_id bigint, duration_ms bigint")


def test_window_layout(spark):
    w = I.window_layout(_runs(spark, 120_000, 1_500_000, None), 600_000, 10_000)
    assert sorted_rows(w) == [(0, 0, 0, 120_000), (1, 0, 0, 600_000), (1, 1, 590_000, 1_190_000), (1, 2, 1_180_000, 1_500_000)]


def test_shots(spark):
    cases = {100_000: ([], 15_000, [(0, 100_000)]), 60_000: ([5_000, 8_000, 30_000], 12_000, [(0, 30_000), (30_000, 60_000)]), 55_000: ([50_000], 15_000, [(0, 55_000)]), 10_000: ([5_000], 15_000, [(0, 10_000)])}
    for dur, (cuts, least, want) in cases.items():
        c = spark.createDataFrame([(0, x) for x in cuts], "run_id bigint, cut_ms bigint")
        got = [(r["start_ms"], r["end_ms"]) for r in I.shots(c, _runs(spark, dur), least).orderBy("shot_idx").collect()]
        assert got == want


def test_split_bounds_against_walk(spark):
    rng = random.Random(3)
    data, want = [], []
    for run in range(12):
        dur = rng.randrange(10_000, 400_000)
        mids = sorted(rng.sample(range(500, dur), rng.randrange(0, 14)))
        data.append((run, dur, mids))
        pos, k = 0.0, 0
        while dur - pos > 30_000:
            near = [m for m in mids if pos + 1000 < m <= pos + 30_000]
            cut = float(max(near)) if near else pos + 30_000
            want.append((run, k, pos, cut))
            pos, k = cut, k + 1
        want.append((run, k, pos, float(dur)))
    runs = spark.createDataFrame([(r, d) for r, d, _ in data], "run_id bigint, duration_ms bigint")
    sil = spark.createDataFrame([(r, float(m)) for r, _, ms in data for m in ms], "run_id bigint, middle_ms double")
    assert sorted_rows(I.split_bounds(runs, sil)) == sorted(want, key=repr)


def test_cue_pieces_and_coverage(spark):
    cue = "run_id bigint, cue_idx int, start_ms bigint, end_ms bigint, text string"
    seg = "run_id bigint, idx int, start_ms bigint, end_ms bigint"
    c = spark.createDataFrame([(1, 0, 10_000, 14_000, "alpha beta gamma delta"), (1, 1, 1, 1, "none"), (1, 2, 20_000, 21_000, None)], cue)
    s = spark.createDataFrame([(1, 0, 8_000, 12_000), (1, 1, 12_000, 16_000), (1, 2, 0, 5_000)], seg)
    assert sorted_rows(I.cue_pieces(c, s).select("idx", "piece", "overlap_ms")) == [(0, "alpha beta", 2000), (1, "gamma delta", 2000)]
    c2 = spark.createDataFrame([(1, 0, 1_000, 4_000, "We use it."), (1, 1, 4_500, 7_000, "It works.")], cue)
    r = I.subtitle_coverage(c2, spark.createDataFrame([(1, 0, 1_000, 7_000)], seg)).first()
    assert (r["coverage"], r["sub_text"]) == (0.9167, "We use it. It works.")


def test_reference_clips(spark):
    seg = "run_id bigint, idx int, start_ms bigint, end_ms bigint"
    lens = {1: (2, 5, 8, 11, 15), 2: (1.6, 2.2, 1.8), 3: (17, 18), 4: (0.5, 30)}
    s = spark.createDataFrame([(k, i, 0, int(d * 1000)) for k, ds in lens.items() for i, d in enumerate(ds)], seg)
    assert sorted_rows(I.reference_clips(s).select("run_id", "idx")) == [(1, 3), (2, 1), (3, 1)]


def test_place_clips(spark):
    seg = "run_id bigint, idx int, start_ms bigint, clip_ms bigint"
    s = spark.createDataFrame([(0, 0, 0, 1000), (0, 1, 1300, 3000), (0, 2, 2300, 2000), (0, 3, 3300, 1000), (0, 4, 4300, None)], seg)
    r = {x["idx"]: (x["placed_ms"], x["overran"]) for x in I.place_clips(s, _runs(spark, 20_000)).collect()}
    assert r[0] == (150.0, False) and r[1] == (1300.0, True) and r[2][1] and r[3] == (3300.0, False) and r[4] == (None, False)


def test_as_of(spark):
    p = spark.createDataFrame([(1, 0, 5), (1, 1, 10), (1, 2, 1), (2, 0, 3)], "run_id bigint, idx int, t bigint")
    s = spark.createDataFrame([(1, 2, 7), (1, 10, 8)], "run_id bigint, start bigint, v bigint")
    assert sorted_rows(I.as_of(p, s, "t", "start", "v", "idx").select("run_id", "idx", "v")) == [(1, 0, 7), (1, 1, 8), (1, 2, None), (2, 0, None)]
