"""Literal cases of the scalar text functions."""

import duckdb
from conftest import sorted_rows
from pyspark.sql import functions as F

from cuewright.functions import text as T
from cuewright.plans import texts


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_clock(spark):
    assert one(spark, T.clock, 3661042, "bigint") == "01:01:01,042"
    assert one(spark, T.clock, -500, "bigint") == "00:00:00,000"
    assert one(spark, T.clock, None, "bigint") == "00:00:00,000"
    assert one(spark, T.parse_clock, "01:01:01,042") == 3661042
    assert one(spark, T.parse_clock, "1:1:1,42") is None


def test_sentence_end(spark):
    cases = {"done.": True, 'done."': True, "done,": False, "…": True, "": False, None: False, "e.g": False}
    for word, want in cases.items():
        assert one(spark, T.ends_sentence, word) is want


def test_normalize(spark):
    assert one(spark, T.normalize, "Hello, World! It's") == ["hello", "world", "it's"]
    assert one(spark, T.normalize, "") == []
    assert one(spark, T.normalize, None) is None


def test_counts(spark):
    assert one(spark, T.syllables, "xin chào") == 2
    assert one(spark, T.syllables, "22. Regularization là gì?") == 6
    assert one(spark, T.syllables, "") == 1
    assert one(spark, T.chars, "bonjour") == 7
    assert one(spark, T.chars, "  hi  ") == 2


def test_lists(spark):
    assert one(spark, T.pair_list, "A=x, B=y,broken,=z,C=") == {"A": "x", "B": "y"}
    assert one(spark, T.pair_list, "") == {}
    assert one(spark, T.comma_list, " a, ,b,") == ["a", "b"]
    text = "Seen.\nKEYWORDS: Kubernetes; CI/CD; transfer learning\nKEYWORDS: later"
    assert one(spark, T.keyword_line, text) == ["Kubernetes", "CI/CD", "transfer learning"]
    assert one(spark, T.without_keyword_line, text) == "Seen.\n\nKEYWORDS: later"
    assert one(spark, T.keyword_line, "nothing here") == []


def test_tempo_chain(spark):
    assert one(spark, T.tempo_chain, 1.35, "double") == [1.35]
    assert one(spark, T.tempo_chain, 8.0, "double") == [2.0, 2.0, 2.0]
    assert one(spark, T.tempo_chain, 0.25, "double") == [0.5, 0.5]
    assert one(spark, T.tempo_chain, 0.0, "double") is None


def test_fingerprint(spark):
    df = spark.createDataFrame([(4, "hello")], "budget int, en string").select(T.fingerprint(en=F.col("en"), budget=F.col("budget")).alias("f"))
    assert df.first()["f"] == "53cfa70c6405d4eb51fcd2c389084481254bc74caafcb57afc7d22001d9e400e"


def test_errors(spark):
    df = spark.createDataFrame([(503, "", False), (422, "", False), (429, "", True), (429, "", False), (None, "ReadTimeout", False), (None, "ConnectionError", False), (None, "ValueError", False)], "s int, n string, l boolean")
    got = [tuple(r) for r in df.select(T.error_class(F.col("s"), F.col("n"), F.col("l")), T.error_code(F.col("s"), F.col("n"))).collect()]
    assert got == [("infra", "http_503"), ("content", "http_422"), ("infra", "http_429"), ("content", "http_429"), ("infra", "timeout"), ("infra", "connection"), ("content", "ValueError")]


def test_json_and_names(spark):
    assert one(spark, T.embedded_json, 'Sure:\n```json\n[{"i": 1}]\n```') == '[{"i": 1}]'
    assert one(spark, T.embedded_json, 'x {"a": [1]} y') == '{"a": [1]}'
    assert one(spark, T.embedded_json, "none") is None
    assert one(spark, lambda c: T.sidecar_name(c, F.lit("fr")), "clip.fr") == "clip.fr.srt"
    assert one(spark, lambda c: T.sidecar_name(c, F.lit("fr")), "clip") == "clip.fr.srt"
    assert one(spark, T.skippable, " <end> ") and one(spark, T.skippable, " ") and not one(spark, T.skippable, "a<b>")
    assert one(spark, T.base_tag, "FR-fr") == "fr"
    assert one(spark, T.filter_path, "a:b'c") == "a\\:b\\'c"


def test_line_fingerprints_of_percent_and_backslash(spark, tmp_path):
    lines = ["rose by 5%", "50% more", "a\\b", "plain", "%", None, 'say "no", / ok', "two\nlines\tand \x01", "für – 日程"]
    rows = [(1, i, float(i), i + 1.0, None, t, None, False, None) for i, t in enumerate(lines)]
    path = str(tmp_path / "segments.parquet")
    spark.createDataFrame(rows, "run_id bigint, idx int, start_s double, end_s double, text_src string, text_target string, speaker string, skipped boolean, feed string").write.parquet(path)
    got = sorted_rows(texts.line_fingerprints(spark, str(tmp_path)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW segments AS SELECT * FROM '{path}/*.parquet'")
    assert got == sorted(con.execute(texts.ORACLES["line_fingerprints"]).fetchall(), key=repr) and [r[1] for r in got] == [0, 1, 2, 3, 4, 6, 7, 8]
    # Every mark counts: lines that differ only in them have keys of their own.
    assert len({r[2] for r in got}) == 8
