"""Greedy packing of ordered items under budgets, as higher-order folds over each run's or item's own array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .intervals import words_in_segments

BOUNDARY, HARDWRAP = "boundary", "hardwrap"
_CLAUSE_END = r"""[,;:.!?…]["')\]}»”’]*$"""


def pack(items: Column, zero: Column, fits, add) -> Column:
    """Group number of each item of an array: an item opens a group unless it ``fits(state, item)``; ``add(state, item)`` joins it.

    ``zero`` is the state of a group that holds nothing yet.
    """
    start = F.struct(F.lit(-1).alias("g"), zero.alias("s"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        stay = (acc["g"] >= 0) & fits(acc["s"], x)
        g = F.when(stay, acc["g"]).otherwise(acc["g"] + 1)
        state = F.when(stay, add(acc["s"], x)).otherwise(add(zero, x))
        return F.struct(g.alias("g"), state.alias("s"), F.concat(acc["out"], F.array(g)).alias("out"))

    return F.aggregate(items, start, step, lambda acc: acc["out"])


def source_cues(words: DataFrame, segments: DataFrame, max_chars: int, max_ms: int) -> DataFrame:
    """``run_id, idx, cue_no, start_ms, end_ms, text``: a segment's words packed into cues at word times.

    A word opens a cue if the joined text would exceed ``max_chars`` or the time ``max_ms``. A
    segment with text but without words is one cue over its whole span. ``segments`` holds
    ``run_id, idx, start_ms, end_ms, text_src``.
    """
    inside = words_in_segments(words, segments).join(words.select("run_id", "word_idx", "start_ms", "end_ms", "word"), ["run_id", "word_idx"])
    ws = inside.groupBy("run_id", "idx").agg(F.array_sort(F.collect_list(F.struct("word_idx", "start_ms", "end_ms", "word"))).alias("ws"))
    zero = F.struct(F.lit(-1).alias("chars"), F.lit(0).cast("bigint").alias("from"))
    fits = lambda s, w: (s["chars"] + 1 + F.length(w["word"]) <= max_chars) & (w["end_ms"] - s["from"] <= max_ms)
    add = lambda s, w: F.struct((s["chars"] + 1 + F.length(w["word"])).alias("chars"), F.when(s["chars"] < 0, w["start_ms"]).otherwise(s["from"]).alias("from"))
    rows = ws.select("run_id", "idx", F.explode(F.arrays_zip("ws", pack(F.col("ws"), zero, fits, add).alias("g"))).alias("x"))
    cues = rows.groupBy("run_id", "idx", F.col("x.g").alias("cue_no")).agg(
        F.min("x.ws.start_ms").alias("start_ms"), F.max_by("x.ws.end_ms", "x.ws.word_idx").alias("end_ms"),
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct(F.col("x.ws.word_idx").alias("i"), F.col("x.ws.word").alias("w")))), lambda y: y["w"])).alias("text"))
    silent = segments.join(ws.select("run_id", "idx"), ["run_id", "idx"], "left_anti").where(T.strip(F.col("text_src")) != "")
    whole = silent.select("run_id", "idx", F.lit(0).alias("cue_no"), "start_ms", "end_ms", F.col("text_src").alias("text"))
    return cues.unionByName(whole)


def target_cues(segments: DataFrame, bounds: DataFrame, max_chars: int, max_ms: int) -> DataFrame:
    """``run_id, idx, cue_no, start_ms, end_ms, text``: a translation tiled over its segment without gap or overlap.

    Words are taken while the joined text and the proportional time fit; a cue that does not end the
    text ends at its last clause mark after its first word, if there is one. Times follow the curve
    of the spoken words' ends (``bounds``: ``run_id, idx, k, bound_ms``), linear between them, or the
    plain proportion where no word is covered. ``segments`` holds ``run_id, idx, start_ms, end_ms, text_target``.
    """
    s = segments.withColumn("toks", T.whitespace_words(F.col("text_target"))).where(F.size("toks") > 0)
    n, span = F.size("toks"), F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1))
    # The widest group from each position, then the last clause mark inside it: two arrays per text,
    # so that the walk over the groups is a fold over positions.
    widths = F.transform("toks", lambda t: F.length(t))
    ends = F.transform("toks", lambda t: t.rlike(_CLAUSE_END))
    s = s.withColumn("n", n).withColumn("widths", widths).withColumn("marks", ends).withColumn("span", span)

    # State: open group's first position, characters in it, last position after a clause mark in it.
    zero = F.struct(F.lit(0).alias("a"), F.lit(-1).alias("chars"), F.lit(0).alias("clause"), F.lit(-1).alias("over"), F.array(F.lit(0)).alias("cuts"))

    def chars_of(a, b):
        return F.aggregate(F.slice("widths", a + 1, b - a), F.lit(-1), lambda x, y: x + y + 1)

    def last_mark(a, b):
        """The cut after the last clause mark among the positions after ``a`` and before ``b``, else 0."""
        inner = F.slice("marks", a + 2, F.greatest(b - a - 1, F.lit(0)))
        at = F.array_max(F.transform(inner, lambda m, i: F.when(m, a + 2 + i).otherwise(F.lit(0))))
        return F.coalesce(at, F.lit(0))

    def step(acc, i):
        a = acc["a"]
        fits = (acc["chars"] + 1 + F.get("widths", i) <= max_chars) & ((i + 1 - a) * F.col("span") <= F.lit(max_ms) * F.col("n"))
        cut = F.when(acc["clause"] > a, acc["clause"]).otherwise(i)
        # After a cut the words between it and i belong to the new group already.
        chars = F.when(cut == i, F.lit(-1)).otherwise(chars_of(cut, i)) + 1 + F.get("widths", i)
        grown = F.struct(a.alias("a"), (acc["chars"] + 1 + F.get("widths", i)).alias("chars"), F.when(F.get("marks", i) & (i > a), i + 1).otherwise(acc["clause"]).alias("clause"), acc["over"].alias("over"), acc["cuts"].alias("cuts"))
        mark = F.when(F.get("marks", i) & (i > cut), i + 1).otherwise(F.when(cut == i, F.lit(0)).otherwise(last_mark(cut, i)))
        opened = F.struct(cut.alias("a"), chars.alias("chars"), mark.alias("clause"), acc["over"].alias("over"), F.concat(acc["cuts"], F.array(cut)).alias("cuts"))
        return F.when((i == a) | fits, grown).otherwise(opened)

    folded = s.withColumn("cuts", F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), zero, step, lambda acc: acc["cuts"]))
    curve = bounds.groupBy("run_id", "idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "bound_ms"))), lambda x: x["bound_ms"]).alias("curve"))
    folded = folded.join(curve, ["run_id", "idx"], "left").withColumn("curve", F.when(F.col("curve").isNull(), F.array("start_ms", "end_ms")).otherwise(F.concat(F.array("start_ms"), "curve")))
    rows = folded.select("*", F.posexplode("cuts").alias("cue_no", "a")).withColumn("b", F.coalesce(F.get("cuts", F.col("cue_no") + 1), F.col("n")))

    def time_at(pos):
        p = F.col(pos) / F.col("n") * (F.size("curve") - 1)
        i = F.floor(p).cast("int")
        last = i >= F.size("curve") - 1
        lo, hi = F.get("curve", i), F.get("curve", i + 1)
        return F.when(last, F.element_at("curve", -1).cast("double")).otherwise(lo + (p - i) * (hi - lo))

    text = F.concat_ws(" ", F.slice("toks", F.col("a") + 1, F.col("b") - F.col("a")))
    return rows.select("run_id", "idx", "cue_no", time_at("a").alias("start_ms"), time_at("b").alias("end_ms"), text.alias("text"))


def _wrap(piece: Column, budget: int, count, joint: int) -> Column:
    """A piece over budget cut after the word that reaches the budget: (text, break before, count).

    A stretch of words counts as its words and ``joint`` for each space between them, so each word is
    counted once.
    """
    words = F.transform(T.whitespace_words(piece), lambda w: F.struct(w.alias("w"), count(w).alias("n")))
    zero = F.struct(F.array().cast("array<struct<t:string,n:int>>").alias("out"), F.lit("").alias("cur"), F.lit(0).alias("n"))
    close = lambda acc: F.concat(acc["out"], F.array(F.struct(acc["cur"].alias("t"), acc["n"].alias("n"))))

    def step(acc, x):
        # The state before says whether the open stretch is full, so its text is built once per word.
        full = acc["n"] >= budget
        fresh = full | (acc["cur"] == "")
        return F.struct(
            F.when(full, close(acc)).otherwise(acc["out"]).alias("out"),
            F.when(fresh, x["w"]).otherwise(F.concat(acc["cur"], F.lit(" "), x["w"])).alias("cur"),
            F.when(fresh, x["n"]).otherwise(acc["n"] + joint + x["n"]).alias("n"),
        )

    parts = F.aggregate(words, zero, step, lambda acc: F.when(acc["cur"] != "", close(acc)).otherwise(acc["out"]))
    return F.transform(parts, lambda p, i: F.struct(p["t"].alias("t"), F.when(i == 0, BOUNDARY).otherwise(HARDWRAP).alias("k"), p["n"].alias("n")))


def speech_chunks(text: Column, budget: int, count, joint: int = 0) -> Column:
    """Chunks of a text as (text, break before it): sentences packed while their counts add up within the budget.

    A sentence over budget is cut into clauses, a clause over budget at words. Spaces between
    sentences do not count; ``joint`` is what a space inside a stretch adds to ``count`` (0 for
    syllables, 1 for characters). Blank texts give no chunk.
    """
    if budget < 1:
        raise ValueError("the budget of a chunk is at least 1")
    # Each text is counted once: it travels as (text, break before, count).
    counted = lambda ts: F.transform(ts, lambda t: F.struct(t.alias("t"), F.lit(BOUNDARY).alias("k"), count(t).alias("n")))
    broken = lambda x: _wrap(x["t"], budget, count, joint)
    within = lambda f: lambda x: F.when(x["n"] <= budget, F.array(x)).otherwise(f(x))
    of_clauses = lambda x: F.flatten(F.transform(counted(T.clauses(x["t"])), within(broken)))
    atoms = F.flatten(F.transform(counted(T.sentences(text)), within(of_clauses)))
    zero = F.struct(F.array().cast("array<struct<t:string,k:string>>").alias("out"), F.lit(None).cast("string").alias("cur"), F.lit(BOUNDARY).alias("k"), F.lit(0).alias("n"))

    def step(acc, a):
        stay = acc["cur"].isNotNull() & (acc["n"] + a["n"] <= budget)
        return F.struct(
            F.when(stay | acc["cur"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(acc["cur"].alias("t"), acc["k"].alias("k"))))).alias("out"),
            F.when(stay, F.concat(acc["cur"], F.lit(" "), a["t"])).otherwise(a["t"]).alias("cur"),
            F.when(stay, acc["k"]).otherwise(a["k"]).alias("k"),
            F.when(stay, acc["n"] + a["n"]).otherwise(a["n"]).alias("n"),
        )

    close = lambda acc: F.when(acc["cur"].isNotNull(), F.concat(acc["out"], F.array(F.struct(acc["cur"].alias("t"), acc["k"].alias("k"))))).otherwise(acc["out"])
    return F.aggregate(atoms, zero, step, close)


def clip_batches(lines: DataFrame, most: int, budget: float, voices: int = 2) -> DataFrame:
    """``run_id, idx, batch``: lines grouped in order until ``most`` lines, the unit budget or another distinct speaker than ``voices`` is reached.

    ``lines`` holds ``run_id, idx, units, speaker`` (null speakers count as one unknown speaker). A
    line over the budget is a batch by itself.
    """
    per = lines.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("idx", F.col("units").cast("double").alias("units"), F.coalesce("speaker", F.lit("")).alias("speaker")))).alias("xs"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("units"), F.array().cast("array<string>").alias("who"))
    who = lambda s, x: F.array_union(s["who"], F.array(x["speaker"]))
    fits = lambda s, x: (s["n"] < most) & (s["units"] + x["units"] <= budget) & (F.size(who(s, x)) <= voices)
    add = lambda s, x: F.struct((s["n"] + 1).alias("n"), (s["units"] + x["units"]).alias("units"), who(s, x).alias("who"))
    rows = per.select("run_id", F.explode(F.arrays_zip("xs", pack(F.col("xs"), zero, fits, add).alias("g"))).alias("x"))
    return rows.select("run_id", F.col("x.xs.idx").alias("idx"), F.col("x.g").alias("batch"))


def context_batches(lines: DataFrame, size: int, near: int, most_visuals: int = 3) -> DataFrame:
    """``run_id, batch, first_idx, last_idx, before, after, visuals``: consecutive lines with the ``near`` source lines on either side.

    ``lines`` holds ``run_id, idx, text, visual``; batches count dense positions, not ``idx``. The
    visuals are the first ``most_visuals`` distinct descriptions in order.
    """
    w = Window.partitionBy("run_id").orderBy("idx")
    pos = F.row_number().over(w) - 1
    texts = lambda a, b: F.collect_list("text").over(w.rowsBetween(a, b))
    none = F.array().cast("array<string>")
    x = lines.withColumn("batch", F.floor(pos / size).cast("int")).withColumn("b", texts(-near, -1) if near else none).withColumn("a", texts(1, near) if near else none)
    seen = F.transform(F.array_sort(F.collect_list(F.when(F.col("visual").isNotNull() & (F.col("visual") != ""), F.struct("idx", "visual")))), lambda v: v["visual"])
    return x.groupBy("run_id", "batch").agg(
        F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.min_by("b", "idx").alias("before"), F.max_by("a", "idx").alias("after"), F.slice(F.array_distinct(seen), 1, most_visuals).alias("visuals"))


def previous_translations(lines: DataFrame, size: int, last: int) -> DataFrame:
    """``run_id, batch, previous``: the last ``last`` translations before a batch; failed (null) ones are passed over. ``last`` of 0 gives none."""
    w = Window.partitionBy("run_id").orderBy("idx")
    x = lines.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    # Only the last ones of each batch can be among the last ones before a later batch.
    said = F.collect_list(F.when(F.col("text").isNotNull(), F.struct("idx", "text")))
    own = x.groupBy("run_id", "batch").agg(F.slice(F.reverse(F.array_sort(said)), 1, max(last, 1)).alias("t")).withColumn("has", F.size("t") > 0)
    # Among batches that have any, ``last`` of them suffice; a batch then takes the state of the nearest one before it.
    state = F.flatten(F.collect_list("t").over(Window.partitionBy("run_id", "has").orderBy("batch").rowsBetween(1 - max(last, 1), 0)))
    upto = own.withColumn("state", F.when(F.col("has"), F.slice(F.reverse(F.array_sort(state)), 1, max(last, 1))))
    before = F.last("state", True).over(Window.partitionBy("run_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1))
    none = F.array().cast("array<struct<idx:int,text:string>>")
    recent = F.reverse(F.coalesce(before, none)) if last else none
    return upto.select("run_id", "batch", recent.alias("r")).select("run_id", "batch", F.transform("r", lambda v: v["text"]).alias("previous"))
