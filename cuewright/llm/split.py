"""Splitting oversized items at natural boundaries (problem 3): content-defined chunking of timed words.

A rolling hash over the words chooses landmarks, so they depend on content only; each snaps to the
nearest sentence end. A piece ends at the first landmark past the minimum, or at the last sentence
end within the maximum where there is none, so an edit alters only the pieces next to it. A sentence
that is too long by itself is cut inside, at the clause mark or pause nearest its landmark.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import base_lang, delivered_once, finite, partitioned, table
from . import sentences as S
from .sentence_ops import BLOCK_WORDS, HALO_WORDS, WordBlock, by_run_blocks, each_group, fit_model, run_styles

#: Words in the rolling hash; one word in LANDMARK_WORDS is a landmark, so about one sentence end in three.
HASH_WORDS = 4
LANDMARK_WORDS = 25
#: Least length of a piece as a share of the maximum, before a landmark may end it. A small one lets
#: the cuts meet again soon after an edit.
LEAST_SHARE = 0.2
PAUSE_S = 0.25
#: Sentences and items are laid into time buckets of this length to be joined.
BUCKET_S = 60.0
SLACK_S = 0.001


_BASE = 0x9E3779B97F4A7C15


def rolling_hashes(words: list[str]) -> np.ndarray:
    """Hash of each word with the HASH_WORDS - 1 words before it: a polynomial whose oldest term drops out as a word comes in."""
    known: dict[str, int] = {}
    h = np.fromiter((known[w] if w in known else known.setdefault(w, zlib.crc32(S.norm(w).encode("utf-8", "surrogatepass"))) for w in words), np.uint64, len(words))
    out = h.copy()
    with np.errstate(over="ignore"):
        for k in range(1, min(HASH_WORDS, len(h))):
            out[k:] += h[:-k] * np.uint64(pow(_BASE, k, 1 << 64))
        out = (out ^ (out >> np.uint64(29))) * np.uint64(_BASE)
    return out >> np.uint64(33)


@dataclass
class Unit:
    """A stretch that is kept whole: a sentence, or a part (``alone``) of one that is too long; ``mark`` tells that a landmark snapped to its end."""

    start: float
    end: float
    last_idx: int
    mark: bool
    sentence_end: bool
    alone: bool = False


def split_long(starts: np.ndarray, ends: np.ndarray, idx: np.ndarray, marks: np.ndarray, natural: np.ndarray, room: float) -> list[Unit]:
    """Parts of a sentence, each at most ``room`` seconds: the landmark of each window snaps to the nearest natural place in it."""
    out: list[Unit] = []
    a, n = 0, len(idx)
    while a < n:
        if ends[n - 1] - starts[a] <= room:
            out.append(Unit(float(starts[a]), float(ends[n - 1]), int(idx[n - 1]), False, True, True))
            break
        fit = np.flatnonzero(ends[a : n - 1] - starts[a] <= room) + a
        if len(fit) == 0:
            b = a  # a single word over the limit stays whole
        else:
            late = fit[ends[fit] - starts[a] >= 0.4 * room]
            window = late if len(late) else fit[-1:]
            landmark = window[np.argmin(marks[window])]
            places = window[natural[window]]
            b = int(places[np.argmin(np.abs(places - landmark))]) if len(places) else int(landmark)
        out.append(Unit(float(starts[a]), float(ends[b]), int(idx[b]), False, b == n - 1, True))
        a = b + 1
    return out


def chunk(units: list[Unit], limit: float, overlap: float) -> list[tuple[int, int]]:
    """Pieces as (first unit, last unit): each fits the limit from ``overlap`` before its cut to its end.

    A piece ends at the first landmark past the minimum; without one in reach, at the last sentence
    end that is; without any, at the last unit that fits. What fits whole after a cut is the last
    piece. The parts of a sentence that is too long share no piece with other sentences.
    """
    pieces: list[tuple[int, int]] = []
    a, n = 0, len(units)
    while a < n:
        base = units[a].start if a == 0 else units[a - 1].end
        begin = base if a == 0 else min(units[a].start, base - overlap)
        b = a
        while b + 1 < n and units[b + 1].end - begin <= limit + 1e-6 and not (units[b].sentence_end and (units[b].alone or units[b + 1].alone)):
            b += 1
        if b + 1 < n:
            ends = [k for k in range(a, b + 1) if units[k].sentence_end and units[k].end - base >= LEAST_SHARE * limit]
            if ends:
                b = next((k for k in ends if units[k].mark), ends[-1])
        pieces.append((a, b))
        a = b + 1
    return pieces


# -- DataFrame operators -------------------------------------------------------------------------------


def timed_sentences(words: DataFrame, model: S.Model, long_s: float, block: int = BLOCK_WORDS, halo: int = HALO_WORDS, styles: DataFrame | None = None) -> DataFrame:
    """``run_id, first_idx, last_idx, start_s, end_s, to_start, to_end, p_*``: sentences of the word streams with their times.

    ``to_start`` and ``to_end`` tell whether a landmark in the sentence is nearest to its start or its
    end. ``p_*`` hold the words (index, start, end, hash, natural place) of sentences longer than
    ``long_s`` seconds, the only ones that may have to be cut inside; they are null for the others.
    """
    shared = words.sparkSession.sparkContext.broadcast(model)
    schema = "run_id bigint, first_idx int, last_idx int, start_s double, end_s double, to_start boolean, to_end boolean, p_idx array<int>, p_start array<double>, p_end array<double>, p_mark array<bigint>, p_natural array<boolean>"
    names = [f.split(" ")[0] for f in schema.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        rows: list[tuple] = []
        for t in each_group(batches, ["run_id", "_block"]):
            w = WordBlock(t, block)
            if not w.words:
                continue
            starts, ends = w.seconds("start_s"), w.seconds("end_s")
            last = S.stream_ends(w.words, starts, ends, m, w.style)
            hashes = rolling_hashes(w.words)
            landmark = hashes % LANDMARK_WORDS == 0
            first = 0
            for e in last:
                if w.core[e]:
                    a, b = starts[first], ends[e]
                    at = ends[first : e + 1][landmark[first : e + 1]]
                    early = at - a < b - at
                    row = (w.run_id, int(w.idx[first]), int(w.idx[e]), float(a), float(b), bool(early.any()), bool((~early).any()))
                    if b - a > long_s:
                        seg = slice(first, e + 1)
                        gap = np.append(starts[first + 1 : e + 1] - ends[first:e], 0.0)
                        clause = np.fromiter((x[-1] in ",;:、，；：—–" for x in w.words[seg]), bool, e + 1 - first)
                        row += (w.idx[seg].tolist(), starts[seg].tolist(), ends[seg].tolist(), hashes[seg].tolist(), (clause | (gap >= PAUSE_S)).tolist())
                    else:
                        row += (None,) * 5
                    rows.append(row)
                first = e + 1
            if len(rows) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), types)], names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), types)], names)

    return by_run_blocks(words, ["start_s", "end_s", "word"], block, halo, styles).mapInArrow(run, schema)


def split_items(items: DataFrame, sentences: DataFrame) -> DataFrame:
    """``run_id, idx, piece, from_s, to_s, first_word_idx, last_word_idx, cut, forced`` of every oversized item.

    ``items`` holds ``run_id, idx, start_s, end_s, max_dur_s, overlap_s``, one row per item. The
    sentences of an item are those that lie whole within its span. ``from_s`` is ``overlap_s``
    before the cut that opens the piece; ``cut`` tells what ends it (sentence, inside, end), and
    ``forced`` that the sentences before and after the cut do not fit the limit together, so that any
    pieces within the limit are cut there. Items
    without words give no row. Joined on the run and a time bucket, so a hot run is spread out.
    """
    bucket = lambda c: F.floor(F.col(c) / BUCKET_S)
    spans = items.select("run_id", "idx", F.col("start_s").alias("item_start"), F.col("end_s").alias("item_end"), "max_dur_s", "overlap_s", F.explode(F.sequence(bucket("start_s"), bucket("end_s"))).alias("_bucket"))
    inside = (F.col("start_s") >= F.col("item_start") - SLACK_S) & (F.col("end_s") <= F.col("item_end") + SLACK_S)
    # A start just before the span may fall into the bucket before it.
    keyed = sentences.withColumn("_bucket", F.floor((F.col("start_s") + SLACK_S) / BUCKET_S))
    pairs = spans.join(keyed, ["run_id", "_bucket"]).where(inside).drop("_bucket", "item_start", "item_end")
    rows = partitioned(pairs, "run_id", "idx").sortWithinPartitions("run_id", "idx", "start_s", "first_idx")
    schema = "run_id bigint, idx int, piece int, from_s double, to_s double, first_word_idx int, last_word_idx int, cut string, forced boolean"
    names = [f.split(" ")[0] for f in schema.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_group(batches, ["run_id", "idx"]):
            c = t.to_pydict()
            limit, overlap = c["max_dur_s"][0], min(c["overlap_s"][0] or 0.0, 0.5 * c["max_dur_s"][0])
            units: list[Unit] = []
            starts = c["start_s"]
            forced = {c["last_idx"][i] for i in range(len(starts) - 1) if c["end_s"][i + 1] - starts[i] > limit + 1e-6}
            firsts: list[int] = []
            for i in range(len(starts)):
                room = limit if not units else limit - overlap - max(0.0, starts[i] - units[-1].end)
                parts = c["p_idx"][i]
                mark = c["to_end"][i] or i + 1 < len(starts) and c["to_start"][i + 1]
                if parts is not None and c["end_s"][i] - starts[i] > max(room, 0.25 * limit):
                    cut = split_long(*(np.asarray(c[k][i]) for k in ("p_start", "p_end", "p_idx", "p_mark", "p_natural")), max(min(room, limit - overlap), 0.25 * limit))
                    order = [-1, *(parts.index(u.last_idx) for u in cut[:-1])]
                    firsts += [parts[k + 1] for k in order]
                    units += cut
                else:
                    units.append(Unit(starts[i], c["end_s"][i], c["last_idx"][i], mark, True))
                    firsts.append(c["first_idx"][i])
            out = []
            for k, (a, b) in enumerate(chunk(units, limit, overlap)):
                begin = units[a].start if k == 0 else units[a - 1].end - overlap
                cut = "end" if b == len(units) - 1 else "sentence" if units[b].sentence_end else "inside"
                out.append((c["run_id"][0], c["idx"][0], k, begin, units[b].end, firsts[a], units[b].last_idx, cut, cut == "sentence" and units[b].last_idx in forced))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, ty) for x, ty in zip(zip(*out), types)], names)

    return rows.mapInArrow(run, schema)


def oversized(segments: DataFrame, runs: DataFrame, limits: DataFrame) -> DataFrame:
    """Segments longer than the limit of their run's target language; spans that are open, NaN or reversed are no items."""
    langs = runs.select("run_id", base_lang(F.col("target_lang")).alias("lang"))
    bounds = limits.groupBy(base_lang(F.col("lang")).alias("lang")).agg(F.min("max_dur_s").alias("max_dur_s"), F.min("overlap_s").alias("overlap_s"))
    spans = segments.select("run_id", "idx", finite(F.col("start_s")).alias("start_s"), finite(F.col("end_s")).alias("end_s"))
    return spans.join(langs, "run_id").join(bounds, "lang").where(F.col("end_s") - F.col("start_s") > F.col("max_dur_s")).drop("lang")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    model = fit_model(spark, d)
    limits = table(spark, d, "split_limits", "lang", "max_dur_s", "overlap_s")
    shortest = limits.agg(F.min(F.col("max_dur_s") - 2 * F.col("overlap_s"))).first()[0]
    segments = delivered_once(table(spark, d, "segments", "run_id", "idx", "start_s", "end_s", "loaded_at"), "run_id", "idx")
    items = oversized(segments, table(spark, d, "runs", "run_id", "target_lang"), limits)
    words = table(spark, d, "words", "run_id", "word_idx", "start_s", "end_s", "word")
    # Only runs with an oversized item need their words.
    needed = words.join(items.select("run_id").distinct(), "run_id", "left_semi")
    return split_items(items, timed_sentences(needed, model, (shortest or 0.0) * 0.75, styles=run_styles(words)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).where("forced").select("run_id", "idx", F.col("last_word_idx").alias("cut_word_idx"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Every piece of every oversized item."""
    return _pieces(spark, d)


QUERIES = {"p3_found": p3_found, "p3_pieces": p3_pieces}
ORACLES: dict[str, str] = {}
