"""Grouping of an ordered word or token stream into spans (set-based: windows and aggregates)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def _order(key: str, order: str):
    return Window.partitionBy(key).orderBy(order)


def number_islands(df: DataFrame, key: str, order: str, closes: Column, name: str) -> DataFrame:
    """Adds ``name``: how many closing rows stand before this one, so a span ends with its closing row."""
    before = _order(key, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(closes.cast("int")).over(before), F.lit(0)).cast("bigint"))


def punct_spans(words: DataFrame) -> DataFrame:
    """``run_id, span, first_idx, last_idx, start_ms, end_ms, n_words``: spans that end at each word with an end mark.

    The rest of a run without a mark is its last span. A null word has no mark.
    """
    w = number_islands(words, "run_id", "word_idx", T.ends_sentence(F.col("word")), "span")
    return w.groupBy("run_id", "span").agg(
        F.min("word_idx").alias("first_idx"), F.max("word_idx").alias("last_idx"), F.min("start_ms").alias("start_ms"),
        F.max_by("end_ms", "word_idx").alias("end_ms"), F.count(F.lit(1)).alias("n_words"))


def span_speakers(words: DataFrame) -> DataFrame:
    """``run_id, span, speaker, n``: the commonest speaker of each span; of equal ones the one heard first. Spans of unknown speakers give no row."""
    w = number_islands(words, "run_id", "word_idx", T.ends_sentence(F.col("word")), "span").where(F.col("speaker").isNotNull())
    votes = w.groupBy("run_id", "span", "speaker").agg(F.count(F.lit(1)).alias("n"), F.min("word_idx").alias("first"))
    best = votes.groupBy("run_id", "span").agg(F.max(F.struct("n", (-F.col("first")).alias("f"), "speaker")).alias("b"))
    return best.select("run_id", "span", "b.speaker", "b.n")


def slots(spans: DataFrame, order: str, total: DataFrame) -> DataFrame:
    """Adds ``slot_ms``: from the start of a span to the start of the next one, for the last to the end of the run (``duration_ms``)."""
    nxt = F.lead("start_ms").over(_order("run_id", order))
    return spans.join(total.select("run_id", "duration_ms"), "run_id", "left").withColumn("slot_ms", F.coalesce(nxt, "duration_ms") - F.col("start_ms")).drop("duration_ms")


def word_gaps(words: DataFrame) -> DataFrame:
    """``run_id, word_idx, gap_ms, middle_ms``: the silence after each word but the last and its middle."""
    nxt = F.lead("start_ms").over(_order("run_id", "word_idx"))
    out = words.withColumn("nxt", nxt).where("nxt is not null and end_ms is not null")
    return out.select("run_id", "word_idx", (F.col("nxt") - F.col("end_ms")).alias("gap_ms"), ((F.col("nxt") + F.col("end_ms")) / 2).alias("middle_ms"))


def best_splits(words: DataFrame, max_ms: int, pause_ms: int) -> DataFrame:
    """``run_id, span, cut_idx``: where a span over ``max_ms`` is best cut in two.

    Of the gaps of at least ``pause_ms`` the one nearest the middle of the span; without any the
    largest gap, of equal ones the nearest to the middle. The first of what is still equal.
    """
    w = number_islands(words, "run_id", "word_idx", T.ends_sentence(F.col("word")), "span")
    own = Window.partitionBy("run_id", "span")
    w = w.withColumn("nxt", F.lead("start_ms").over(own.orderBy("word_idx"))).withColumn("a", F.min("start_ms").over(own)).withColumn("b", F.max("end_ms").over(own))
    g = w.where((F.col("b") - F.col("a") > max_ms) & F.col("nxt").isNotNull())
    gap = F.col("nxt") - F.col("end_ms")
    off = F.abs(F.col("nxt") + F.col("end_ms") - F.col("a") - F.col("b"))
    pause = gap >= pause_ms
    rank = F.struct(pause.cast("int").alias("p"), F.when(pause, -off).otherwise(gap).alias("x"), F.when(pause, F.lit(0)).otherwise(-off).alias("y"), (-F.col("word_idx")).alias("z"))
    return g.groupBy("run_id", "span").agg(F.max_by("word_idx", rank).alias("cut_idx"))


def group_tokens(tokens: DataFrame, least: int = 10, most_ratio: int = 8) -> DataFrame:
    """``run_id, word_no, word, start_ms, end_ms, speaker``: words from sub-word tokens.

    ``tokens`` holds ``run_id, tok_idx, text, start_ms, end_ms, speaker``. Blank tokens and
    ``<...>`` markers are dropped first and break no word; a token that begins with whitespace opens
    a word. A run of at least ``least`` tokens with more than ``most_ratio`` of them to a word is
    refused, since its tokens carry no word starts.
    """
    t = tokens.where(F.col("text").isNotNull() & ~T.skippable(F.col("text")))
    opens = F.col("text").rlike(r"^\s").cast("int")
    w = _order("run_id", "tok_idx")
    first = F.row_number().over(w) == 1
    t = t.withColumn("word_no", (F.sum(F.when(first, 1).otherwise(opens)).over(w) - 1).cast("bigint"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("tok_idx", "text"))), lambda x: x["text"])
    words = t.groupBy("run_id", "word_no").agg(
        T.strip(F.concat_ws("", parts)).alias("word"), F.min_by("start_ms", "tok_idx").alias("start_ms"), F.max_by("end_ms", "tok_idx").alias("end_ms"),
        F.min_by("speaker", "tok_idx").alias("speaker"), F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("run_id")
    bad = (F.sum("n").over(run) >= least) & (F.sum("n").over(run) > most_ratio * F.count(F.lit(1)).over(run))
    return words.select("run_id", "word_no", F.when(bad, F.raise_error(F.lit("tokens without word starts"))).otherwise(F.col("word")).alias("word"), "start_ms", "end_ms", "speaker")


def majority(df: DataFrame, key: str, value: str, fallback: str, least_share: float = 0.9) -> DataFrame:
    """``key, value, share, mixed``: the commonest non-null value per key.

    Mixed if there are several and the first has less than ``least_share``; of equal ones the least
    in order. A key without any value takes ``fallback`` and counts as mixed.
    """
    n = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col(value).isNotNull(), F.col("n"))
    agg = n.groupBy(key).agg(F.sum(known).alias("total"), F.count(known).alias("kinds"), F.max(known).alias("most"))
    top = n.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, "n").alias("_any"), F.max("n").alias("most"))
    least = n.where(F.col(value).isNotNull()).join(top.select(key, F.col("most").alias("m")), key).where("n = m").groupBy(key).agg(F.min(value).alias("top"))
    out = agg.join(least, key, "left")
    share = F.col("most") / F.col("total")
    return out.select(key, F.coalesce("top", F.lit(fallback)).alias(value), share.alias("share"), F.when(F.col("most").isNull(), F.lit(True)).otherwise((F.col("kinds") > 1) & (share < least_share)).alias("mixed"))


def mark_density(words: DataFrame) -> DataFrame:
    """``run_id, density``: the share of words that end a sentence."""
    return words.groupBy("run_id").agg(F.avg(T.ends_sentence(F.col("word")).cast("int")).alias("density"))


def dedup_windowed(words: DataFrame) -> DataFrame:
    """Words of overlapping recognition windows once each: per start to the hundredth second the first window's.

    Input ``run_id, win_idx, pos, start_ms, ...``; order of the result is start, then window and position.
    """
    w = Window.partitionBy("run_id", F.bround(F.col("start_ms") / 10)).orderBy("win_idx", "pos")
    return words.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def silence_runs(samples: DataFrame, key: str, order: str, value: str, level: float, least: int) -> DataFrame:
    """``key, first, last, n``: maximal runs of at least ``least`` samples under ``level`` in absolute value (gaps and islands)."""
    quiet = F.abs(F.col(value)) < level
    w = _order(key, order)
    g = samples.select(key, order, quiet.alias("quiet")).withColumn("island", F.col(order) - F.sum(F.col("quiet").cast("int")).over(w))
    return g.where("quiet").groupBy(key, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("island")
