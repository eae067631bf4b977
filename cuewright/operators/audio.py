"""Sample arrays as columns: gates, trimming, fading, splitting and mixing of short clips (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import amplitude


def peak(samples: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(samples, F.abs)), F.lit(0.0))


def qa_code(samples: Column, rate: int, units: Column, units_per_s: Column, silence_db: float = -50.0, least_s: float = 0.3, least_share: float = 0.3, most_share: float = 3.0, most_floor_s: float = 2.5) -> Column:
    """The first gate a clip fails, in order: undecodable, too_short, too_long, silent; null if it passes."""
    seconds = F.size(samples) / F.lit(float(rate))
    expected = units / units_per_s
    return (
        F.when(samples.isNull(), "undecodable")
        .when(seconds < F.greatest(F.lit(least_s), expected * least_share), "too_short")
        .when(seconds > F.greatest(expected * most_share, F.lit(most_floor_s)), "too_long")
        .when(peak(samples) <= amplitude(F.lit(silence_db)), "silent")
    )


def _loud(samples: Column, level: float) -> Column:
    return F.filter(F.transform(samples, lambda v, i: F.when(F.abs(v) > level, i)), lambda i: i.isNotNull())


def trim_edges(samples: Column, level: float) -> Column:
    """Without the quiet samples at both ends; an all quiet clip stays as it is."""
    loud = _loud(samples, level)
    return F.when(F.size(loud) == 0, samples).otherwise(F.slice(samples, F.array_min(loud) + 1, F.array_max(loud) - F.array_min(loud) + 1))


def last_loud(samples: Column, level: float = 1e-4) -> Column:
    """Position of the last sample above a level; null if there is none."""
    return F.array_max(_loud(samples, level))


def fade(samples: Column, n: int) -> Column:
    """Linear fade over ``n`` samples at both ends, over half the clip at most."""
    k = F.least(F.lit(n), F.floor(F.size(samples) / 2).cast("int"))
    ramp = lambda i: F.when(k > 0, F.least(F.lit(1.0), i / F.greatest(k, F.lit(1)))).otherwise(F.lit(1.0))
    return F.transform(samples, lambda v, i: v * ramp(i) * ramp(F.size(samples) - 1 - i))


def mono(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: (a + b) / 2)


def clip(samples: Column) -> Column:
    return F.transform(samples, lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)))


def mix_timeline(clips: DataFrame) -> DataFrame:
    """``run_id, sample, value``: clips summed where they lie, limited to [-1, 1].

    ``clips`` holds ``run_id, idx, at, room, samples``: the first sample of a clip and how many it may
    take (null: all), so that a clip which spills never sounds over the next. Samples are rows, so a
    timeline of any length is summed with partial sums over the cluster, never held whole.
    """
    cut = F.when(F.col("room").isNull(), F.col("samples")).otherwise(F.slice("samples", F.lit(1), F.greatest(F.col("room"), F.lit(0))))
    rows = clips.where("samples is not null").select("run_id", "at", F.posexplode(cut).alias("i", "v"))
    total = rows.groupBy("run_id", (F.col("at") + F.col("i")).alias("sample")).agg(F.sum(F.col("v").cast("double")).alias("v"))
    return total.select("run_id", "sample", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("v"))).alias("value"))


def split_turns(clips: DataFrame, level: float, least: int, edge: int) -> DataFrame:
    """``clip_id, piece, first, last``: a clip of ``n`` turns cut at the middles of its ``n - 1`` longest inner silences, each piece without quiet ends.

    ``clips`` holds ``clip_id, n, samples``. Silences of fewer than ``least`` samples or within
    ``edge`` samples of an end do not count; a clip with too few gives no row.
    """
    s = clips.select("clip_id", "n", F.size("samples").alias("len"), F.posexplode("samples").alias("i", "v"))
    w = Window.partitionBy("clip_id").orderBy("i")
    q = s.withColumn("quiet", F.abs("v") < level).withColumn("g", F.col("i") - F.sum(F.col("quiet").cast("int")).over(w))
    runs = q.where("quiet").groupBy("clip_id", "n", "len", "g").agg(F.min("i").alias("a"), (F.max("i") + 1).alias("b")).where((F.col("b") - F.col("a") >= least) & (F.col("a") > edge) & (F.col("b") < F.col("len") - edge))
    rank = F.row_number().over(Window.partitionBy("clip_id").orderBy(F.desc(F.col("b") - F.col("a")), "a"))
    top = runs.withColumn("k", rank).where(F.col("k") < F.col("n"))
    cuts = top.groupBy("clip_id").agg(F.array_sort(F.collect_list(F.bround((F.col("a") + F.col("b")) / 2).cast("int"))).alias("cuts"))
    whole = clips.join(cuts, "clip_id", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<int>"))).where(F.size("cuts") == F.col("n") - 1)
    bounds = F.concat(F.array(F.lit(0)), "cuts", F.array(F.size("samples")))
    parts = whole.withColumn("bounds", bounds).select("clip_id", "samples", "bounds", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("piece"))
    a, b = F.get("bounds", F.col("piece")), F.get("bounds", F.col("piece") + 1)
    loud = _loud(F.slice("samples", a + 1, b - a), level)
    quiet = F.size(loud) == 0
    return parts.select("clip_id", "piece", F.when(quiet, a).otherwise(a + F.array_min(loud)).alias("first"), F.when(quiet, b - 1).otherwise(a + F.array_max(loud)).alias("last"))
