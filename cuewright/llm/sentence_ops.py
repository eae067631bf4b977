"""Sentence units of values and of word streams as DataFrame operators (problem 1)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import delivered_once, partitioned, table
from . import sentences as S

#: Words of a run are decoded in blocks of this many word indices; a block also sees this many words
#: on either side, far more than a sentence, so that a cut does not depend on where blocks meet.
BLOCK_WORDS = 8192
HALO_WORDS = 512
_NO_LETTERS = "".join(map(chr, range(33, 65))) + "[\\]^_`{|}~" + "".join(sorted(set("…。！？｡”’»」』】）〉》“«„「『、，；：‘¿¡–—♪")))
_DENSE = "\u0E00-\u0EFF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF"


def _rank(keys: list[str], weight: Column | None = None) -> Column:
    """A number from 0 to 1 by key hash, divided by the weight: rows of a larger weight come first more often."""
    h = F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(2**53))
    return h if weight is None else h / weight


def script_weight(text: Column) -> Column:
    """Texts of scripts that are rare in a collection but have boundaries of their own count several times."""
    return F.when(text.rlike("[\u0E00-\u0E7F]{4}"), 6.0).when(text.rlike("[\u3040-\u30FF]{2}|[\u3400-\u9FFF]{2}"), 3.0).otherwise(1.0)


def bounded_sample(df: DataFrame, keys: list[str], column: str, most: int, weight: Column | None = None) -> list[str]:
    """At most ``most`` values of a column, those of the smallest key ranks: the same rows in every run."""
    rows = df.where(F.col(column).isNotNull()).select(column, _rank(keys, weight).alias("_h")).orderBy("_h", column).limit(most).collect()
    return [r[0] for r in rows]


def fit_model(spark: SparkSession, d: str, units: int = S.SAMPLE_UNITS, texts: int = S.SAMPLE_TEXTS) -> S.Model:
    """The boundary model of a data folder, fitted on at most ``units`` cues and ``texts`` values of each field."""
    cues = bounded_sample(table(spark, d, "cues", "run_id", "cue_idx", "text"), ["run_id", "cue_idx"], "text", units, script_weight(F.col("text")))
    segments = table(spark, d, "segments", "run_id", "idx", "text_src", "text_target")
    weight = F.greatest(*[script_weight(F.coalesce(c, F.lit(""))) for c in ("text_src", "text_target")])
    pairs = segments.select("text_src", "text_target", _rank(["run_id", "idx"], weight).alias("_h")).orderBy("_h", "text_src", "text_target").limit(texts).collect()
    return S.fit(cues, [t for r in pairs for t in r[:2]])


def value_sentences(df: DataFrame, model: S.Model, keys: list[str], fields: list[str]) -> DataFrame:
    """One row ``keys, field, end_pos`` per sentence of a value that is followed by another one.

    Null and empty values, and values of sound notes only, give no row. ``df`` must hold each key
    once; other columns are ignored. Values are decoded whole, whatever their length.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(*keys, *fields)
    kinds = {f.name: f.dataType for f in src.schema.fields}
    schema = ", ".join(f"{k} {kinds[k].simpleString()}" for k in keys) + ", field string, end_pos int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for f in fields:
                at: list[int] = []
                ends: list[int] = []
                for i, text in enumerate(b.column(f).to_pylist()):
                    if text:
                        found = S.sentence_ends(text, m)
                        if found:
                            at.extend([i] * len(found))
                            ends.extend(found)
                if at:
                    take = pa.array(at)
                    yield pa.RecordBatch.from_arrays([b.column(k).take(take) for k in keys] + [pa.array([f] * len(at)), pa.array(ends, pa.int32())], [*keys, "field", "end_pos"])

    return src.mapInArrow(run, schema)


def run_styles(words: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """``run_id, _block, _style``: :func:`sentences.stream_style` of the whole run as the bits of a number, for every block of a run of several.

    Counts are added up before the shuffle, so no run is gathered. A word weighs as often as it was
    delivered.
    """
    w = F.col("word")
    said = lambda c: F.when(F.trim(w) != "", c)
    marked = F.count_if(said(F.instr(F.lit(S.MARKED), F.substring("word", -1, 1)) > 0))
    # Regular expressions are run on words of such scripts only; those are never ASCII.
    unspaced = (F.octet_length(w) > F.length(w)) & w.rlike(f"[{_DENSE}]")
    dense = F.sum(F.when(unspaced, F.length(F.regexp_replace(w, f"[^{_DENSE}]+", ""))).otherwise(0))
    letters = F.sum(F.length(F.translate(w, _NO_LETTERS, "")))
    spaced = F.bool_or(said(F.coalesce(unspaced & w.rlike("[\u0E00-\u0EFF]"), F.lit(False))))
    bits = (marked <= S.BARE_SHARE * F.count(said(F.lit(1))), (dense > 0) & (dense * 3 > letters - dense), spaced)
    style = sum((F.when(b, 2**k).otherwise(0) for k, b in enumerate(bits)), F.when(spaced.isNotNull(), 0))
    known = words.where(F.col("run_id").isNotNull() & F.col("word_idx").isNotNull())
    runs = known.groupBy("run_id").agg(F.max("word_idx").alias("last"), style.alias("_style")).where((F.col("last") >= block) & F.col("_style").isNotNull())
    return runs.select("run_id", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / block).cast("int"))).alias("_block"), "_style")


def by_run_blocks(words: DataFrame, columns: list[str], block: int = BLOCK_WORDS, halo: int = HALO_WORDS, styles: DataFrame | None = None) -> DataFrame:
    """Words shuffled by run and block and sorted by index, with the neighbours of each block repeated in it.

    Adds ``_block`` and ``_style``. A block of a run of several begins with a row of index -1 that
    holds its style (``styles``, by default of these words); it travels in the same shuffle. Rows
    without a run or an index have no place in a stream and are left out.
    """
    i = F.col("word_idx")
    k = F.floor(i / F.lit(block)).cast("int")
    inside = i - k * block
    blocks = F.when(inside < halo, F.array(k - 1, k)).when(inside >= block - halo, F.array(k, k + 1)).otherwise(F.array(k))
    rows = words.where(F.col("run_id").isNotNull() & i.isNotNull()).select("run_id", "word_idx", *columns, F.explode(blocks).alias("_block"))
    rows = rows.where(F.col("_block") >= F.lit(0)) if halo else rows
    heads = (run_styles(words, block) if styles is None else styles).withColumn("word_idx", F.lit(-1))
    rows = rows.withColumn("_style", F.lit(None).cast("int")).unionByName(heads, allowMissingColumns=True)
    return partitioned(rows, "run_id", "_block").sortWithinPartitions("run_id", "_block", "word_idx")


def each_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys from sorted batches; a group that spans batches is put together."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for b in batches:
        if b.num_rows == 0:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(b.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for lo, hi in zip(bounds, bounds[1:]):
            key = tuple(c[lo].item() for c in cols)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class WordBlock:
    """One block of a run: words once each and in order; ``core`` tells which belong to the block itself."""

    def __init__(self, t: pa.Table, block: int):
        self.run_id, number, style = (t.column(c)[0].as_py() for c in ("run_id", "_block", "_style"))
        self.style = None if style is None else tuple(bool(style >> k & 1) for k in range(3))
        if style is not None:
            t = t.slice(1)
        idx = t.column("word_idx").to_numpy()
        keep = np.ones(len(idx), dtype=bool)
        keep[1:] = idx[1:] != idx[:-1]
        if not keep.all():
            t, idx = t.filter(pa.array(keep)), idx[keep]
        said = [w if w is not None else "" for w in t.column("word").to_pylist()]
        blank = [not w or w.isspace() for w in said]
        if any(blank):
            some = ~np.asarray(blank)
            t, idx, said = t.filter(pa.array(some)), idx[some], [w for w, x in zip(said, blank) if not x]
        self.table, self.idx, self.words = t, idx, said
        self.core = idx // block == number

    def seconds(self, column: str) -> np.ndarray:
        return self.table.column(column).to_numpy().astype(float)


def stream_sentences(words: DataFrame, model: S.Model, block: int = BLOCK_WORDS, halo: int = HALO_WORDS) -> DataFrame:
    """``run_id, last_idx, first_idx``: the sentences of each run's word stream, the last one included.

    Words delivered twice count once; null and blank words are skipped; null or NaN times only lose
    the pause. A run is decoded in blocks with a halo, so a run of any length is spread over tasks.
    """
    shared = words.sparkSession.sparkContext.broadcast(model)
    rows = by_run_blocks(words, ["start_s", "end_s", "word"], block, halo)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        runs: list[int] = []
        firsts: list[np.ndarray] = []
        lasts: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(runs, pa.int64()), pa.array(np.concatenate(lasts), pa.int32()), pa.array(np.concatenate(firsts), pa.int32())], ["run_id", "last_idx", "first_idx"])

        for t in each_group(batches, ["run_id", "_block"]):
            w = WordBlock(t, block)
            if not w.words:
                continue
            ends = np.asarray(S.stream_ends(w.words, w.seconds("start_s"), w.seconds("end_s"), m, w.style))
            starts = np.concatenate(([0], ends[:-1] + 1))
            mine = w.core[ends]
            if mine.any():
                runs.extend([w.run_id] * int(mine.sum()))
                lasts.append(w.idx[ends[mine]])
                firsts.append(w.idx[starts[mine]])
            if len(runs) > 20_000:
                yield out()
                runs, firsts, lasts = [], [], []
        if runs:
            yield out()

    return rows.mapInArrow(run, "run_id bigint, last_idx int, first_idx int")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    model = fit_model(spark, d)
    segments = delivered_once(table(spark, d, "segments", "run_id", "idx", "text_src", "text_target", "loaded_at"), "run_id", "idx")
    values = value_sentences(segments, model, ["run_id", "idx"], ["text_src", "text_target"]).select("run_id", "field", "idx", "end_pos")
    stream = stream_sentences(table(spark, d, "words", "run_id", "word_idx", "start_s", "end_s", "word"), model)
    return values.unionByName(stream.select("run_id", F.lit("words").alias("field"), F.col("last_idx").alias("idx"), F.lit(0).alias("end_pos")))


QUERIES = {"p1_found": p1_found}
ORACLES: dict[str, str] = {}
