"""Language and engine dimensions, and look-ups along a tag's fallback chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Length model, units a second, reading speed, chunk budget and expansion by language.
PROFILES = [
    ("vi", "syllable", 4.3, 21.0, 60, 1.0, "vi"),
    ("en", "cps", 15.0, 17.0, 240, 1.0, "en"),
    ("fr", "cps", 17.0, 17.0, 240, 1.18, "fr"),
    ("es", "cps", 17.0, 17.0, 240, 1.25, "es"),
]
GENERIC = ("und", "cps", 16.0, 17.0, 240, 1.15, "")
SCHEMA = "locale string, length_model string, rate double, cps_max double, chunk_budget int, expansion double, voice_language string"
MAX_CUE_CHARS, MAX_CUE_S = 84, 6.0


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*PROFILES, GENERIC], SCHEMA)


def tag_chain(tag: Column) -> Column:
    """A tag and its prefixes, the most specific first: ``es_419`` gives ``es-419``, ``es``."""
    parts = F.split(F.lower(F.trim(F.replace(tag, F.lit("_"), F.lit("-")))), "-")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "-"))


def resolve(df: DataFrame, tag: str, key: list[str]) -> DataFrame:
    """Adds the columns of the most specific profile of ``tag``; unknown and null tags take the generic one.

    The profiles are a fixed handful of rows, so they are broadcast; one row per ``key`` stays one row.
    """
    known = profiles(df.sparkSession).where(F.col("locale") != GENERIC[0])
    chain = df.select(*key, F.posexplode_outer(tag_chain(F.col(tag))).alias("_depth", "locale"))
    hit = chain.join(F.broadcast(known), "locale").groupBy(*key).agg(F.min_by(F.struct(*known.columns), "_depth").alias("_p"))
    generic = F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(GENERIC, (c.split(" ") for c in SCHEMA.split(", ")))])
    return df.join(hit, key, "left").withColumn("_p", F.coalesce("_p", generic)).select(*df.columns, "_p.*")


def cue_budget(length_model: Column, cps_max: Column) -> Column:
    """Characters of a target cue: the global bound, for character models no more than the reading speed allows."""
    return F.when(length_model == "syllable", F.lit(MAX_CUE_CHARS)).otherwise(F.least(F.lit(MAX_CUE_CHARS), F.floor(cps_max * MAX_CUE_S).cast("int")))


def cast_voices(speakers: DataFrame, pool: list[str], default: str, pins: dict[str, str] | None = None) -> DataFrame:
    """``run_id, speaker, voice``: each distinct speaker of a run takes its pin, else the pool's voice at its rank.

    Ranks count all non-empty speakers in order, pinned ones too, so a pin never moves another
    speaker's voice. The empty speaker takes the default; an empty pool is the default alone.
    """
    from pyspark.sql import Window

    voices = pool or [default]
    distinct = speakers.select("run_id", F.coalesce("speaker", F.lit("")).alias("speaker")).distinct()
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.col("speaker") == "", "speaker")) - 1
    fixed = F.create_map(*[F.lit(x) for kv in (pins or {"": ""}).items() for x in kv])
    pooled = F.element_at(F.array(*map(F.lit, voices)), (rank % len(voices) + 1).cast("int"))
    voice = F.when(F.col("speaker") == "", F.lit(default)).otherwise(F.coalesce(F.nullif(fixed[F.col("speaker")], F.lit("")), pooled))
    return distinct.select("run_id", "speaker", voice.alias("voice"))


def unknown_names(configured: DataFrame, known: DataFrame, name: str) -> DataFrame:
    """Configured names that no known one equals, once each and sorted."""
    return configured.select(name).distinct().join(known.select(name), name, "left_anti").orderBy(name)
