"""Relations between timed entities of a run: overlap, point in interval, as-of, layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Both sides of an interval join are laid into buckets of this length, so that a run with very many
#: intervals is joined piece by piece; a pair is kept in the bucket where its overlap begins.
BUCKET_MS = 60_000


def overlap_pairs(a: DataFrame, b: DataFrame, bucket_ms: int = BUCKET_MS) -> DataFrame:
    """Pairs of the same run whose spans overlap in more than a point.

    ``a`` holds ``run_id, a_start, a_end``, ``b`` holds ``run_id, b_start, b_end`` and any other
    columns. Spans without length are dropped.
    """
    bucket = lambda x: F.floor(x / F.lit(bucket_ms))
    lay = lambda df, s, e: df.where(F.col(e) > F.col(s)).withColumn("_bucket", F.explode(F.sequence(bucket(F.col(s)), bucket(F.col(e) - 1))))
    pairs = lay(a, "a_start", "a_end").join(lay(b, "b_start", "b_end"), ["run_id", "_bucket"])
    meets = (F.col("a_start") < F.col("b_end")) & (F.col("a_end") > F.col("b_start"))
    return pairs.where(meets & (F.col("_bucket") == bucket(F.greatest("a_start", "b_start")))).drop("_bucket")


def cue_pieces(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """``run_id, idx, cue_idx, cue_start, overlap_ms, piece``: the words of each cue that fall into each segment.

    A cue's words are spread evenly over its time; a segment takes those between the rounded (half
    to even) positions of the overlap's two ends.
    """
    c = cues.where(F.col("text").isNotNull()).select("run_id", "cue_idx", F.col("start_ms").alias("a_start"), F.col("end_ms").alias("a_end"), "text")
    s = segments.select("run_id", "idx", F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    p = overlap_pairs(c, s).withColumn("o0", F.greatest("a_start", "b_start")).withColumn("o1", F.least("a_end", "b_end"))
    words = T.whitespace_words(F.col("text"))
    length = F.col("a_end") - F.col("a_start")
    at = lambda o: F.bround((F.col(o) - F.col("a_start")) / length * F.size("ws")).cast("int")
    p = p.withColumn("ws", words).withColumn("i", at("o0")).withColumn("j", at("o1"))
    piece = F.when(F.col("j") > F.col("i"), F.concat_ws(" ", F.slice("ws", F.col("i") + 1, F.col("j") - F.col("i")))).otherwise(F.lit(""))
    return p.select("run_id", "idx", "cue_idx", F.col("a_start").alias("cue_start"), (F.col("o1") - F.col("o0")).alias("overlap_ms"), piece.alias("piece"))


def subtitle_coverage(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """``run_id, idx, coverage, sub_text``: share of a segment's time under cues (at most 1; cues that overlap count twice) and their text in order."""
    p = cue_pieces(cues, segments)
    texts = F.array_sort(F.collect_list(F.when(F.col("piece") != "", F.struct("cue_start", "piece"))))
    agg = p.groupBy("run_id", "idx").agg(F.sum("overlap_ms").alias("covered"), F.concat_ws(" ", F.transform(texts, lambda x: x["piece"])).alias("sub_text"))
    out = segments.where(F.col("end_ms") > F.col("start_ms")).select("run_id", "idx", (F.col("end_ms") - F.col("start_ms")).alias("dur")).join(agg, ["run_id", "idx"], "left")
    share = F.round(F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / F.col("dur")), 4)
    return out.select("run_id", "idx", share.alias("coverage"), F.coalesce("sub_text", F.lit("")).alias("sub_text"))


def words_in_segments(words: DataFrame, segments: DataFrame) -> DataFrame:
    """``run_id, idx, word_idx``: words that start within a segment, its end left out."""
    w = words.where("start_ms is not null").select("run_id", "word_idx", F.col("start_ms").alias("a_start"), (F.col("start_ms") + 1).alias("a_end"))
    s = segments.select("run_id", "idx", F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    return overlap_pairs(w, s).select("run_id", "idx", "word_idx")


def as_of(points: DataFrame, spans: DataFrame, at: str, start: str, value: str, order: str) -> DataFrame:
    """Adds ``value`` of the last span that starts at or before ``at`` in the same run: one union and a running last, no range join."""
    p = points.withColumn("_t", F.col(at)).withColumn("_kind", F.lit(1)).withColumn("_v", F.lit(None).cast("bigint"))
    s = spans.select("run_id", F.col(start).alias("_t"), F.lit(0).alias("_kind"), F.col(value).cast("bigint").alias("_v"))
    both = p.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy("run_id").orderBy("_t", "_kind", order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", True).over(w)).where("_kind = 1").drop("_t", "_kind", "_v")


def shots(cuts: DataFrame, runs: DataFrame, least_ms: int) -> DataFrame:
    """``run_id, shot_idx, start_ms, end_ms``: shots between the cuts that are kept.

    A cut is kept at least ``least_ms`` after the last kept one and before the end of the run; a
    last shot shorter than that joins the one before. The fold runs over the sorted cuts of a run.
    """
    sorted_cuts = F.array_sort(F.collect_set("cut_ms"))
    per = runs.where("duration_ms is not null").select("run_id", "duration_ms").join(cuts.groupBy("run_id").agg(sorted_cuts.alias("cuts")), "run_id", "left")
    start = F.array(F.lit(0).cast("bigint"))
    keep = lambda acc, c: F.when((c > F.element_at(acc, -1)) & (c - F.element_at(acc, -1) >= least_ms), F.concat(acc, F.array(c))).otherwise(acc)
    folded = per.withColumn("kept", F.aggregate(F.filter(F.coalesce("cuts", F.array().cast("array<bigint>")), lambda c: c.isNotNull() & (c > 0) & (c < F.col("duration_ms"))), start, keep))
    stub = (F.size("kept") > 1) & (F.col("duration_ms") - F.element_at("kept", -1) < least_ms)
    folded = folded.withColumn("kept", F.when(stub, F.slice("kept", F.lit(1), F.size("kept") - 1)).otherwise(F.col("kept")))
    rows = folded.select("run_id", "duration_ms", "kept", F.posexplode("kept").alias("shot_idx", "start_ms"))
    return rows.select("run_id", "shot_idx", "start_ms", F.coalesce(F.get("kept", F.col("shot_idx") + 1), "duration_ms").alias("end_ms"))


def frame_times(windows: DataFrame, count: int) -> DataFrame:
    """The windows with ``frame, at_ms``: ``count`` places evenly spaced from the start; a window of at most a millisecond has one."""
    span = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    n = F.when(span <= 1, F.lit(1)).otherwise(F.lit(max(1, count)))
    rows = windows.withColumn("frame", F.explode(F.sequence(F.lit(0), n - 1)))
    return rows.withColumn("at_ms", F.col("start_ms") + F.col("frame") * span / F.lit(max(1, count)))


def window_layout(runs: DataFrame, window_ms: int, overlap_ms: int) -> DataFrame:
    """``run_id, win_idx, start_ms, end_ms``: recognition windows that overlap by ``overlap_ms``; one window if the run fits."""
    step = window_ms - overlap_ms
    more = F.greatest(F.lit(0), F.ceil((F.col("duration_ms") - window_ms) / F.lit(step))).cast("int")
    rows = runs.where("duration_ms is not null").select("run_id", "duration_ms", F.explode(F.sequence(F.lit(0), more)).alias("win_idx"))
    start = F.col("win_idx").cast("bigint") * step
    return rows.select("run_id", "win_idx", start.alias("start_ms"), F.least(start + window_ms, F.col("duration_ms")).alias("end_ms"))


def split_bounds(runs: DataFrame, silences: DataFrame, max_ms: int = 30_000, margin_ms: int = 1_000) -> DataFrame:
    """``run_id, part, start_ms, end_ms``: clips of at most ``max_ms``, each cut at the latest silence middle in reach, else hard.

    ``silences`` holds ``run_id, middle_ms``. The fold walks the sorted middles once: a cut falls due
    when the next middle lies out of reach, and hard cuts fill stretches without any.
    """
    per = runs.where("duration_ms is not null").select("run_id", F.col("duration_ms").cast("double").alias("dur")).join(silences.groupBy("run_id").agg(F.array_sort(F.collect_list(F.col("middle_ms").cast("double"))).alias("m")), "run_id", "left")
    m = F.filter(F.coalesce("m", F.array().cast("array<double>")), lambda x: x.isNotNull() & (x > 0) & (x < F.col("dur")))
    zero = F.struct(F.array(F.lit(0.0)).alias("cuts"), F.lit(-1.0).alias("seen"))

    def due(acc, x):
        """Cuts needed before a position ``x`` can lie in the open clip: the seen middle, then hard ones."""
        pos, seen = F.element_at(acc["cuts"], -1), acc["seen"]
        late = x - pos > max_ms
        first = F.when(late & (seen > pos + margin_ms), F.concat(acc["cuts"], F.array(seen))).otherwise(acc["cuts"])
        at = F.element_at(first, -1)
        n = F.when(x - at > max_ms, F.ceil((x - at) / F.lit(float(max_ms))) - 1).otherwise(F.lit(0)).cast("int")
        hard = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda k: at + k * F.lit(float(max_ms)))
        return F.concat(first, hard)

    def step(acc, x):
        cuts = due(acc, x)
        return F.struct(cuts.alias("cuts"), F.when(x > F.element_at(cuts, -1) + margin_ms, x).otherwise(F.lit(-1.0)).alias("seen"))

    cuts = F.aggregate(m, zero, step, lambda acc: due(acc, F.col("dur")))
    rows = per.select("run_id", "dur", cuts.alias("cuts")).select("run_id", "dur", "cuts", F.posexplode("cuts").alias("part", "start_ms"))
    return rows.select("run_id", "part", "start_ms", F.coalesce(F.get("cuts", F.col("part") + 1), "dur").alias("end_ms"))


def boundary_curve(words: DataFrame, segments: DataFrame) -> DataFrame:
    """``run_id, idx, k, bound_ms``: the ends of a segment's words, never running back, never past its end, the last one pinned to it."""
    inside = words_in_segments(words, segments)
    w = inside.join(words.select("run_id", "word_idx", "end_ms"), ["run_id", "word_idx"]).join(segments.select("run_id", "idx", F.col("start_ms").alias("s0"), F.col("end_ms").alias("s1")), ["run_id", "idx"])
    own = Window.partitionBy("run_id", "idx").orderBy("word_idx")
    run = F.greatest("s0", F.max("end_ms").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.lead("word_idx").over(own).isNull()
    return w.select("run_id", "idx", F.row_number().over(own).alias("k"), F.when(last, F.col("s1")).otherwise(F.least(run, "s1")).alias("bound_ms"))


def place_clips(segments: DataFrame, runs: DataFrame, most_ms: int = 200, max_tempo: float = 1.35, tolerance: float = 1.10, headroom_ms: int = 1_000) -> DataFrame:
    """``run_id, idx, slot_ms, placed_ms, tempo, overran``: placement of clips in the slots between segment starts.

    ``segments`` holds ``run_id, idx, start_ms, clip_ms`` (null clip: nothing to place). A clip that
    fits is centred by at most ``most_ms``; one that does not keeps its onset and is sped up to at
    most ``max_tempo``. It overran if it still exceeds its slot by the tolerance, for the last one
    by the headroom.
    """
    w = Window.partitionBy("run_id").orderBy("idx")
    nxt = F.lead("start_ms").over(w)
    s = segments.join(runs.select("run_id", "duration_ms"), "run_id").withColumn("last", nxt.isNull()).withColumn("slot_ms", F.coalesce(nxt, "duration_ms") - F.col("start_ms"))
    slack = F.col("slot_ms") - F.col("clip_ms")
    placed = F.when(F.col("clip_ms").isNull(), None).when(slack > 0, F.col("start_ms") + F.least(F.lit(float(most_ms)), slack / 2)).otherwise(F.col("start_ms").cast("double"))
    ratio = F.col("clip_ms") / F.col("slot_ms")
    over = (F.col("slot_ms") > 0) & (slack < 0)
    tempo = F.when(over, F.least(ratio, F.lit(max_tempo))).otherwise(F.lit(1.0))
    capped = F.col("clip_ms") / tempo
    limit = F.when(F.col("last"), F.col("slot_ms") + headroom_ms).otherwise(F.col("slot_ms") * tolerance)
    return s.select("run_id", "idx", "slot_ms", placed.alias("placed_ms"), tempo.alias("tempo"), F.coalesce(over & (capped > limit), F.lit(False)).alias("overran"))


def reference_clips(segments: DataFrame, bands: tuple = ((3_000, 12_000), (1_500, 20_000)), most_ms: int = 12_000) -> DataFrame:
    """``run_id, idx, start_ms, clip_end_ms``: per run the longest segment of the first band that has one, the first of equal ones.

    A run without any gives no row; whoever needs one finds the run by an anti join.
    """
    dur = F.col("end_ms") - F.col("start_ms")
    band = F.lit(None).cast("int")
    for n, (lo, hi) in reversed(list(enumerate(bands))):
        band = F.when((dur >= lo) & (dur <= hi), F.lit(n)).otherwise(band)
    s = segments.withColumn("band", band).where("band is not null")
    best = s.groupBy("run_id").agg(F.max_by(F.struct("idx", "start_ms", "end_ms"), F.struct(-F.col("band"), dur, -F.col("idx"))).alias("b"))
    return best.select("run_id", "b.idx", "b.start_ms", F.least(F.col("b.end_ms"), F.col("b.start_ms") + most_ms).alias("clip_end_ms"))


def longest_gaps(gaps: DataFrame, key: list[str], n: str) -> DataFrame:
    """The ``n - 1`` longest gaps of each key in time order; keys with fewer gaps than that are left out.

    ``gaps`` holds the key columns, ``word_idx, gap_ms`` and the wanted number of pieces ``n``; of
    equal gaps the earlier ones count first.
    """
    w = Window.partitionBy(*key).orderBy(F.desc("gap_ms"), "word_idx")
    g = gaps.withColumn("_rank", F.row_number().over(w)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    return g.where((F.col("_rank") < F.col(n)) & (F.col("_all") >= F.col(n) - 1)).drop("_rank", "_all")
