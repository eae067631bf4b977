"""JSON artifacts and worker output: tolerant readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ends_sentence
from ..operators.spans import number_islands

WORDS_RESPONSE = "status string, text string, words array<struct<start:bigint,end:bigint,text:string,speaker:string>>, utterances array<struct<start:bigint,end:bigint,text:string,speaker:string>>"
TOKENS_RESPONSE = "tokens array<struct<text:string,start_ms:bigint,end_ms:bigint,speaker:string,language:string>>"


def parse_lines(lines: DataFrame, schema: str, must: str, line: str = "value") -> DataFrame:
    """Parsed worker lines; noise (no JSON, or without ``must``) is left out. Unknown fields are dropped, missing ones null."""
    parsed = lines.withColumn("_j", F.from_json(F.col(line), schema, {"mode": "PERMISSIVE"}))
    rest = [c for c in lines.columns if c != line]
    return parsed.where(F.col(f"_j.{must}").isNotNull()).select(*rest, "_j.*")


def read_artifacts(spark: SparkSession, path: str, schema: str, name: str) -> DataFrame:
    """JSON files whose name matches ``name`` in full, with their ``file_stem``; torn ones are passed over."""
    df = spark.read.schema(f"{schema}, _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", "true").option("ignoreMissingFiles", "true").json(path)
    file = F.col("_metadata.file_name")
    return df.where(file.rlike(f"^(?:{name})$")).withColumn("file_stem", F.regexp_replace(file, r"\.json$", "")).where("_corrupt is null").drop("_corrupt")


def response_words(responses: DataFrame, key: str) -> DataFrame:
    """``key, word_idx, word, start_s, end_s, speaker`` of word responses; milliseconds become seconds."""
    w = responses.select(key, F.posexplode("words").alias("word_idx", "w"))
    return w.select(key, "word_idx", F.col("w.text").alias("word"), F.round(F.col("w.start") / 1000, 3).alias("start_s"), F.round(F.col("w.end") / 1000, 3).alias("end_s"), F.col("w.speaker").alias("speaker"))


def response_utterances(responses: DataFrame, key: str) -> DataFrame:
    """``key, utt_idx, speaker, text, start_s, end_s``."""
    u = responses.select(key, F.posexplode("utterances").alias("utt_idx", "u"))
    return u.select(key, "utt_idx", F.col("u.speaker").alias("speaker"), F.col("u.text").alias("text"), F.round(F.col("u.start") / 1000, 3).alias("start_s"), F.round(F.col("u.end") / 1000, 3).alias("end_s"))


def response_tokens(responses: DataFrame, key: str) -> DataFrame:
    """``key, tok_idx, text, start_ms, end_ms, speaker`` of token responses, for grouping into words."""
    t = responses.select(key, F.posexplode("tokens").alias("tok_idx", "t"))
    return t.select(key, "tok_idx", "t.text", "t.start_ms", "t.end_ms", "t.speaker")


def dense_lines(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """The rows whose text is not blank, with ``idx`` counting them from 0 in order; null texts are blank."""
    said = df.where(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s", "") != "")
    return said.withColumn("idx", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)


def response_segments(responses: DataFrame) -> DataFrame:
    """``run_id, idx, start_s, end_s, text, speaker`` of word responses.

    The utterances with a text where there are any; else the words cut at end marks; else the whole
    text over the time of its words. A response with neither words nor utterances gives no row.
    """
    said = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    some = F.coalesce(F.size("utterances") > 0, F.lit(False))
    u = response_utterances(responses.where(some), "run_id")
    u = dense_lines(u, "run_id", "utt_idx", "text").select("run_id", "idx", "start_s", "end_s", said(F.col("text")).alias("text"), F.coalesce("speaker", F.lit("")).alias("speaker"))
    w = response_words(responses.where(~some), "run_id")
    spans = number_islands(w, "run_id", "word_idx", ends_sentence(F.col("word")), "span").groupBy("run_id", "span").agg(
        F.min_by("start_s", "word_idx").alias("start_s"), F.max_by("end_s", "word_idx").alias("end_s"), F.array_sort(F.collect_list(F.struct("word_idx", "word"))).alias("ws"))
    text = F.array_join(F.transform("ws", lambda x: x["word"]), " ")
    cut = spans.select("run_id", F.col("span").cast("int").alias("idx"), "start_s", "end_s", text.alias("text"), F.lit("").alias("speaker"))
    # Utterances that are all blank leave the run to its whole text.
    blank = responses.where(some & (F.size("words") > 0)).join(u.select("run_id").distinct(), "run_id", "left_anti")
    at = lambda x: F.round(x / 1000, 3)
    whole = blank.select("run_id", F.lit(0).alias("idx"), at(F.col("words")[0]["start"]).alias("start_s"), at(F.element_at("words", -1)["end"]).alias("end_s"), said(F.coalesce("text", F.lit(""))).alias("text"), F.lit("").alias("speaker"))
    return u.unionByName(cut).unionByName(whole)


def window_words(output: DataFrame, windows: DataFrame) -> DataFrame:
    """Words of window results at absolute times: ``run_id, win_idx, pos, start_ms, end_ms, word``; windows without words give none."""
    x = output.select("run_id", "win_idx", F.posexplode("words").alias("pos", "w")).join(windows.select("run_id", "win_idx", F.col("start_ms").alias("win_start")), ["run_id", "win_idx"])
    at = lambda c: (F.bround(F.col(f"w.{c}") * 1000) + F.col("win_start")).cast("bigint")
    return x.select("run_id", "win_idx", "pos", at("start").alias("start_ms"), at("end").alias("end_ms"), F.col("w.word").alias("word"))


def rejoined_parts(parts: DataFrame) -> DataFrame:
    """``run_id, job, text, complete``: the texts of a job's parts in order.

    ``parts`` holds ``run_id, job, part, n_parts, text``; a part that came twice counts once, a job
    with a missing or null part is not complete.
    """
    once = parts.where("text is not null").groupBy("run_id", "job", "part").agg(F.min("text").alias("text"), F.max("n_parts").alias("n_parts"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: F.regexp_replace(x["text"], r"^\s+|\s+$", ""))
    return once.groupBy("run_id", "job").agg(F.array_join(listed, " ").alias("text"), (F.count(F.lit(1)) == F.max("n_parts")).alias("complete"))


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a DDL schema in its order and types; unknown ones go, missing ones are null."""
    fields = [c.strip().split(" ", 1) for c in schema.split(",")]
    return df.select(*[(F.col(n).cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in fields])


def window_output(output: DataFrame, windows: DataFrame) -> DataFrame:
    """Segments of window results at absolute times: ``run_id, win_idx, win_start, win_end, start_ms, end_ms, text``.

    ``output`` holds ``run_id, win_idx, segments`` with seconds from the window's start.
    """
    x = output.select("run_id", "win_idx", F.explode("segments").alias("s")).join(windows.select("run_id", "win_idx", F.col("start_ms").alias("win_start"), F.col("end_ms").alias("win_end")), ["run_id", "win_idx"])
    at = lambda c: (F.bround(F.col(f"s.{c}") * 1000) + F.col("win_start")).cast("bigint")
    return x.select("run_id", "win_idx", "win_start", "win_end", at("start").alias("start_ms"), at("end").alias("end_ms"), F.col("s.text").alias("text"))


def overrides(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, seg_id, text`` of override maps; blank values and texts that are no map give no row."""
    m = texts.select(key, F.explode(F.from_json(F.col(text), "map<string,string>")).alias("seg_id", "v"))
    return m.where(F.regexp_replace("v", r"\s", "") != "").select(key, "seg_id", F.col("v").alias("text"))


def requested_items(requested: DataFrame, replies: DataFrame) -> DataFrame:
    """``batch, i, text``: reply items joined to what was asked for; a batch with a missing item or no array gives nulls for all of it.

    ``requested`` holds ``batch, i``; ``replies`` holds ``batch, reply`` (a JSON array of ``{i, text}``).
    """
    items = replies.select("batch", F.explode(F.from_json("reply", "array<struct<i:int,text:string>>")).alias("x")).select("batch", F.col("x.i").alias("i"), F.col("x.text").alias("text"))
    items = items.where("i is not null and text is not null").dropDuplicates(["batch", "i"])
    j = requested.join(items, ["batch", "i"], "left")
    bad = j.where("text is null").select("batch").distinct().withColumn("_bad", F.lit(True))
    return j.join(bad, "batch", "left").select("batch", "i", F.when(F.col("_bad").isNull(), F.col("text")).alias("text"))


def first_audio(parts: Column) -> Column:
    """The bytes of the first part with data, out of base64; null (to be retried) if no part has any."""
    return F.unbase64(F.get(F.filter(parts, lambda p: p["data"].isNotNull()), F.lit(0))["data"])


def speaker_utterances(utterances: DataFrame, key: str) -> DataFrame:
    """``key, utterances``: one JSON list per key in order, as the artifact of a diarised transcript."""
    listed = F.array_sort(F.collect_list(F.struct("utt_idx", "speaker", "text", "start_s", "end_s")))
    return utterances.groupBy(key).agg(F.to_json(F.transform(listed, lambda u: u.dropFields("utt_idx"))).alias("utterances"))
