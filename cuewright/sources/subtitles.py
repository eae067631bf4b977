"""Subtitle texts as rows and rows as subtitle texts, and the choice of a subtitle source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.intervals import boundary_curve
from ..operators.packing import source_cues, target_cues

#: Sidecar endings in order of preference.
SIDECARS = (".en.srt", ".en.vtt", ".srt", ".vtt")
_STAMP = r"(?:(\d+):)?(\d{1,2}):(\d{1,2})(?:[,.](\d{1,3}))?"


def _stamp_ms(line: Column, skip: int) -> Column:
    rx = rf"^\s*{_STAMP}\s*-->\s*{_STAMP}"
    g = lambda i: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(line, rx, i + skip), F.lit("")), F.lit("9" * 9)), F.lit(0)).cast("bigint")
    part = F.rpad(F.regexp_extract(line, rx, 4 + skip), 3, "0")
    millis = F.coalesce(F.try_to_number(F.nullif(part, F.lit("")), F.lit("999")), F.lit(0)).cast("bigint")
    return ((g(1) * 60 + g(2)) * 60 + g(3)) * 1000 + millis


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text`` of whole files; missing and torn files are passed over."""
    df = spark.read.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", "true").text(path, wholetext=True)
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def parse_cues(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, pos, start_ms, end_ms, text``: the cues of SubRip or WebVTT texts in file order.

    A block counts if it has a time line (hours optional, settings after it ignored); tags go, white
    space collapses, empty cues and cues without length are dropped. Null texts give no row.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(text), "\r\n?", "\n"), "^﻿", "")
    blocks = texts.select(key, F.posexplode(F.split(clean, r"\n[ \t]*\n+")).alias("pos", "block"))
    at = F.regexp_extract("block", r"(?m)^([^\n]*-->[^\n]*)$", 1)
    body = F.regexp_replace(F.substring_index(F.concat(F.lit("\n"), "block"), "-->", -1), r"^[^\n]*\n?", "")
    said = T.strip(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", ""), r"\s+", " "))
    rows = blocks.withColumn("line", at).where("line <> ''").select(key, "pos", _stamp_ms(F.col("line"), 0).alias("start_ms"), _stamp_ms(F.col("line"), 4).alias("end_ms"), said.alias("text"))
    return rows.where((F.col("text") != "") & (F.col("end_ms") > F.col("start_ms")))


def render_cues(cues: DataFrame, key: str, order: str, newline: str = "\n") -> DataFrame:
    """``key, srt``: one SubRip text per key.

    Cues without length are dropped first, so the numbers run on without a hole.
    """
    kept = cues.where((F.col("end_ms") > F.col("start_ms")) & F.col("text").isNotNull())
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    block = F.concat_ws(newline, n.cast("string"), F.concat(T.clock(F.col("start_ms")), F.lit(" --> "), T.clock(F.col("end_ms"))), "text")
    blocks = kept.select(key, n.alias("n"), block.alias("b"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "b"))), lambda x: x["b"])
    return blocks.groupBy(key).agg(F.concat(F.concat_ws(newline * 2, ordered), F.lit(newline)).alias("srt"))


def wrapped_srt(words: DataFrame, segments: DataFrame, side: str, max_chars: int, max_ms: int, bounds: DataFrame | None = None) -> DataFrame:
    """``run_id, srt``: the source side in cues at word times, or the target side tiled over its segments along ``bounds``."""
    if side == "source":
        cues = source_cues(words, segments, max_chars, max_ms)
    else:
        cues = target_cues(segments, boundary_curve(words, segments) if bounds is None else bounds, max_chars, max_ms)
    ms = lambda c: F.bround(c).cast("bigint").alias(c)
    return render_cues(cues.select("run_id", F.struct("idx", "cue_no").alias("place"), ms("start_ms"), ms("end_ms"), "text"), "run_id", "place")


def write_srt(rendered: DataFrame, key: str, path: str) -> None:
    """One folder per key with its text; the commit protocol of the file sink makes each write atomic."""
    rendered.select(key, F.col("srt").alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def pick_sidecar(files: DataFrame) -> DataFrame:
    """``run_id, path``: the first existing sidecar of each run by ending; ``files`` holds ``run_id, stem, path``."""
    rank = F.lit(None).cast("int")
    for i, end in reversed(list(enumerate(SIDECARS))):
        rank = F.when(F.col("path") == F.concat("stem", F.lit(end)), F.lit(i)).otherwise(rank)
    return files.withColumn("_r", rank).where("_r is not null").groupBy("run_id").agg(F.min_by("path", "_r").alias("path"))


def pick_track(tracks: DataFrame) -> DataFrame:
    """``run_id, s_index``: the first English track, else the first untagged one, never another language; ``tracks`` holds ``run_id, s_index, language``."""
    lang = F.lower(F.trim(F.coalesce("language", F.lit(""))))
    rank = F.when(lang.isin("en", "eng"), 0).when(lang.isin("", "und"), 1)
    t = tracks.withColumn("_r", rank).where("_r is not null")
    return t.groupBy("run_id").agg(F.min_by("s_index", F.struct("_r", "s_index")).alias("s_index"))


def choose_subtitles(sidecars: DataFrame, embedded: DataFrame) -> DataFrame:
    """``run_id, text``: the sidecar's text where there is one, else the embedded track's."""
    e = embedded.select("run_id", F.col("text").alias("_e"))
    return sidecars.select("run_id", "text").join(e, "run_id", "full").select("run_id", F.coalesce("text", "_e").alias("text"))
