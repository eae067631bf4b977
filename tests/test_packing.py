"""Packing folds: literal cases and comparison with plain walks."""

import random

from conftest import sorted_rows
from pyspark.sql import functions as F

from cuewright.functions import profiles as L
from cuewright.functions import text as T
from cuewright.operators import packing as K


def chunks(spark, text, budget):
    return [tuple(r) for r in spark.createDataFrame([(text,)], "t string").select(F.explode(K.speech_chunks(F.col("t"), budget, T.syllables)).alias("c")).select("c.*").collect()]


def test_speech_chunks(spark):
    assert chunks(spark, "Xin chào các bạn.", 60) == [("Xin chào các bạn.", "boundary")]
    assert chunks(spark, "   ", 60) == []
    assert chunks(spark, None, 60) == []
    four = chunks(spark, "a b c d. e f g h. i j k l. m n o p.", 8)
    assert [c[0] for c in four] == ["a b c d. e f g h.", "i j k l. m n o p."] and {c[1] for c in four[1:]} == {"boundary"}
    hard = chunks(spark, "a b c d e f g h i j", 3)
    assert [c[0] for c in hard] == ["a b c", "d e f", "g h i", "j"] and {c[1] for c in hard[1:]} == {"hardwrap"}
    mixed = chunks(spark, "Ngắn. " + "w " * 9, 3)
    assert mixed[1][1] == "boundary" and {c[1] for c in mixed[2:]} == {"hardwrap"}
    assert len(chunks(spark, "Mất 3.5 giây để chạy.", 60)) == 1
    try:
        chunks(spark, "a", 0)
    except ValueError:
        return
    raise AssertionError("a budget below 1 must be refused")


def test_clip_batches(spark):
    s = "run_id bigint, idx int, units int, speaker string"
    sizes = lambda rows, most, budget: [r[0] for r in K.clip_batches(spark.createDataFrame(rows, s), most, budget).groupBy("batch").count().orderBy("batch").select("count").collect()]
    assert sizes([(1, i, 1, "A") for i in range(5)], 2, 100.0) == [2, 2, 1]
    assert sizes([(1, i, 2, "A") for i in range(3)], 8, 3.0) == [1, 1, 1]
    assert sizes([(1, i, 1, x) for i, x in enumerate("ABACB")], 8, 100.0) == [3, 2]
    assert sizes([(1, 0, 1, None), (1, 1, 1, ""), (1, 2, 1, "A")], 8, 100.0) == [3]


def _walk_target(toks, span, max_chars, max_ms):
    groups, a, n = [], 0, len(toks)
    while a < n:
        b = a + 1
        while b < n and len(" ".join(toks[a : b + 1])) <= max_chars and (b + 1 - a) / n * span <= max_ms:
            b += 1
        if b < n:
            b = next((k + 1 for k in range(b - 1, a, -1) if toks[k].rstrip("\"')]}»”’")[-1:] in tuple(",;:.!?…")), b)
        groups.append((a, b))
        a = b
    return groups


def test_target_cues_against_walk(spark):
    rng = random.Random(9)
    seg = "run_id bigint, idx int, start_ms bigint, end_ms bigint, text_target string"
    rows = [(1, i, 1000, 1000 + rng.choice([1_000, 20_000, 90_000]), " ".join(rng.choice(["aa", "bbbb,", "cc.", "ddddddd", "e", 'f."']) for _ in range(rng.randrange(1, 50)))) for i in range(60)]
    none = spark.createDataFrame([], "run_id bigint, idx int, k int, bound_ms bigint")
    got = {}
    for r in K.target_cues(spark.createDataFrame(rows, seg), none, 20, 6_000).orderBy("idx", "cue_no").collect():
        got.setdefault(r["idx"], []).append((r["text"], r["start_ms"], r["end_ms"]))
    for _, i, a, b, text in rows:
        toks = text.split()
        want = [(" ".join(toks[x:y]), a + x / len(toks) * (b - a), a + y / len(toks) * (b - a)) for x, y in _walk_target(toks, b - a, 20, 6_000)]
        assert [w[0] for w in want] == [g[0] for g in got[i]]
        assert all(abs(w[1] - g[1]) < 1e-6 and abs(w[2] - g[2]) < 1e-6 for w, g in zip(want, got[i]))


def test_target_cues_follow_words(spark):
    s = spark.createDataFrame([(1, 0, 0, 7000, "aa bb cc dd")], "run_id bigint, idx int, start_ms bigint, end_ms bigint, text_target string")
    bounds = spark.createDataFrame([(1, 0, 1, 1000), (1, 0, 2, 2000), (1, 0, 3, 6000), (1, 0, 4, 7000)], "run_id bigint, idx int, k int, bound_ms bigint")
    r = K.target_cues(s, bounds, 5, 60_000).orderBy("cue_no").collect()
    assert [(x["text"], x["start_ms"], x["end_ms"]) for x in r] == [("aa bb", 0.0, 2000.0), ("cc dd", 2000.0, 7000.0)]


def test_context_batches(spark):
    rows = [(1, i, f"en {i}", v) for i, v in enumerate("AABABC" + "C" * 3)]
    df = K.context_batches(spark.createDataFrame(rows, "run_id bigint, idx int, text string, visual string"), 3, 2, 2).orderBy("batch").collect()
    assert [r["before"] for r in df] == [[], ["en 1", "en 2"], ["en 4", "en 5"]]
    assert [r["after"] for r in df] == [["en 3", "en 4"], ["en 6", "en 7"], []]
    assert [r["visuals"] for r in df] == [["A", "B"], ["A", "B"], ["C"]]


def test_previous_translations(spark):
    rows = [(1, i, None if i % 2 else f"t{i}") for i in range(8)]
    df = spark.createDataFrame(rows, "run_id bigint, idx int, text string")
    got = [r["previous"] for r in K.previous_translations(df, 2, 3).orderBy("batch").collect()]
    assert got == [[], ["t0"], ["t0", "t2"], ["t0", "t2", "t4"]]
    assert {tuple(r["previous"]) for r in K.previous_translations(df, 2, 0).collect()} == {()}


def test_profiles_and_voices(spark):
    tags = ["es-MX", "fr-FR", "FR", "es_419", "xx", "zz-ZZ", None]
    r = L.resolve(spark.createDataFrame(list(enumerate(tags)), "run_id int, tag string"), "tag", ["run_id"])
    assert [x["locale"] for x in r.orderBy("run_id").collect()] == ["es", "fr", "fr", "es", "und", "und", "und"]
    cast = lambda sp, pool=("Adrian", "Maya", "Noah", "Nina"), pins=None: dict(sorted_rows(L.cast_voices(spark.createDataFrame([(1, s) for s in sp], "run_id bigint, speaker string"), list(pool), "Adrian", pins).select("speaker", "voice")))
    assert cast("ABA") == {"A": "Adrian", "B": "Maya"}
    assert cast("AB", pins={"A": "Grace"}) == {"A": "Grace", "B": "Maya"}
    assert cast(["A", ""]) == {"": "Adrian", "A": "Adrian"}
    assert cast("ABCDEF")["E"] == "Adrian" and cast("ABCDEF")["F"] == "Maya"
    assert cast("AB", pool=()) == {"A": "Adrian", "B": "Adrian"}


def test_previous_translations_over_many_failed_batches(spark):
    rows = [(1, i, f"t{i}" if i < 2 or i in (70, 71, 90) else None) for i in range(100)] + [(2, i, None) for i in range(8)]
    df = spark.createDataFrame(rows, "run_id bigint, idx int, text string")
    for last in (0, 1, 3):
        got = {(r["run_id"], r["batch"]): r["previous"] for r in K.previous_translations(df, 2, last).collect()}
        walk = lambda k, b: [t for r, i, t in rows if r == k and i < 2 * b and t][-last:] if last else []
        assert got == {(k, b): walk(k, b) for k, n in ((1, 50), (2, 4)) for b in range(n)}
