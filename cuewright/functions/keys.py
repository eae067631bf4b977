"""Content keys of stages: what an output depends on, as one hash per row.

A key is the hash of the compact JSON of its fields in alphabetical order. A field that takes part only
under a condition is left out of the JSON where it is null, so it leaves older keys as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Recognition and synthesis engines, and whether a synthesis engine takes long texts whole.
ASR_ENGINES = ("assemblyai", "local", "soniox")
TTS_ENGINES = {"gemini": True, "higgs": False, "soniox": False, "vieneu": False}
DEFAULT_SOURCE, DEFAULT_TARGET = "en", "vi"


class UnknownEngine(ValueError):
    """An engine name that no provider has."""


def engine(name: str, kind: str = "tts") -> str:
    """``name``, if it is a known engine of its kind; else an error that lists the known ones."""
    known = TTS_ENGINES if kind == "tts" else ASR_ENGINES
    if name not in known:
        raise UnknownEngine(f"unknown {kind} engine {name!r}; known: {', '.join(sorted(known))}")
    return name


def key(always: dict[str, Column], sometimes: dict[str, Column] | None = None) -> Column:
    """sha256 of the fields; those in ``sometimes`` take part only where they are not null."""
    body = lambda fields, nulls: F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields.items())]), {"ignoreNullFields": nulls})
    return F.sha2(F.concat(body(always, "false"), body(sometimes, "true") if sometimes else F.lit("{}")), 256)


def clip_key(text: Column, engine_name: Column, params: Column, voice: Column, ref: Column, chunk_budget: Column, chunk_gap: Column, wrap_gap: Column) -> Column:
    """Key of a synthesised clip: the text, the engine with its parameters, and the reference of a cloned voice or else the preset voice.

    The chunk settings shape the sound of engines that cut long texts, so they are left out for those
    that do not. ``ref`` is null where no voice is cloned.
    """
    whole = engine_name.isin([n for n, native in TTS_ENGINES.items() if native])
    chunked = lambda c: F.when(~whole, c)
    return key(
        {"engine": engine_name, "params": params, "text": text},
        {"ref": ref, "voice": F.when(ref.isNull(), voice), "chunk_budget": chunked(chunk_budget), "chunk_gap": chunked(chunk_gap), "wrap_gap": chunked(wrap_gap)},
    )


def verdict_key(audio: Column, start_ms: Column, end_ms: Column, pivot: Column, reading_sha: Column, sub_text: Column, settings: Column) -> Column:
    """Key of a verdict. A reading enters by the hash of its output, so a new reading makes a new verdict; a null one was not made."""
    return key({"audio": audio, "end": end_ms, "pivot": pivot, "reading": reading_sha, "settings": settings, "start": start_ms, "sub_text": sub_text})


def translation_key(context: Column, prompt: Column, model: Column, source: Column, target: Column) -> Column:
    """Key of a translation prompt; a base language takes part only where it is not the default, so keys made before there were others hold."""
    other = lambda c, default: F.when(c != default, c)
    return key({"context": context, "model": model, "prompt": prompt}, {"source": other(source, DEFAULT_SOURCE), "target": other(target, DEFAULT_TARGET)})


def converged_key(text: Column, slot_ms: Column, tolerance: float, most_rounds: int) -> Column:
    """Key of a text that was shortened until it fits: the text it began with, the slot and the settings."""
    return key({"rounds": F.lit(most_rounds), "slot": slot_ms, "text": text, "tolerance": F.lit(tolerance)})


def mux_key(dub_sha: Column, video: Column, srt_sha: Column, settings: Column, style: Column) -> Column:
    """Key of a finished video; ``style`` is null where no captions are burned in."""
    return key({"dub": dub_sha, "settings": settings, "srt": srt_sha, "video": video}, {"style": style})


def stream_fingerprints(words: DataFrame) -> DataFrame:
    """``run_id, fingerprint`` of a run's words in order with their times in milliseconds.

    Each word is hashed with its place and the hashes are added up in two halves, which is
    associative, so a run of any length is never gathered.
    """
    one = F.sha2(F.to_json(F.struct("word_idx", "start_ms", "end_ms", "word"), {"ignoreNullFields": "false"}), 256)
    half = lambda at: F.sum(F.conv(F.substring("h", at, 14), 16, 10).cast("decimal(38,0)"))
    sums = words.select("run_id", one.alias("h")).groupBy("run_id").agg(half(1).alias("a"), half(15).alias("b"), F.count(F.lit(1)).alias("n"))
    return sums.select("run_id", F.sha2(F.concat_ws(":", F.col("n").cast("string"), F.col("a").cast("string"), F.col("b").cast("string")), 256).alias("fingerprint"))


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, sha256`` of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def file_stamps(spark: SparkSession, path: str) -> DataFrame:
    """``path, size, mtime`` of files without reading them: a cheap identity of very large ones."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def cached_hashes(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``path, size, mtime, sha256``: the hash that the manifest holds for the very same path, size and time, else null (to be computed)."""
    known = manifest.select("path", "size", "mtime", "sha256").dropDuplicates(["path", "size", "mtime"])
    return files.select("path", "size", "mtime").join(known, ["path", "size", "mtime"], "left")
