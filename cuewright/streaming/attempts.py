"""Attempts as a stream: windowed failure counts, sessions and the ledger, exactly once.

An extension: the batch operators give the same results over whole tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ledger import THRESHOLD, WINDOW, _Run


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 4) -> DataFrame:
    """Parquet files as they arrive; the schema is explicit, as a stream has none to infer."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def failure_counts(attempts: DataFrame, time: str, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """``window, error_class, n`` of failures per event-time window (tumbling, or sliding by ``slide``); rows later than ``late`` are dropped."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return attempts.where("op = 'failure'").withWatermark(time, late).groupBy(w.alias("window"), "error_class").agg(F.count(F.lit(1)).alias("n"))


def activity_sessions(attempts: DataFrame, time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``run_id, session, n``: bursts of attempts of a run with no pause over ``gap``."""
    return attempts.withWatermark(time, late).groupBy("run_id", F.session_window(time, gap).alias("session")).agg(F.count(F.lit(1)).alias("n"))


_STATE = "entries map<string,struct<status:string,stage:string,error_class:string,code:string,strikes:int,hash:string,demoted:boolean>>, recent array<struct<seg:string,stage:string,error_class:string,code:string,demoted:boolean>>"


def ledger_stream(attempts: DataFrame, window: int = WINDOW, threshold: int = THRESHOLD) -> DataFrame:
    """``run_id, seq, seg_id, status, aborted``: the ledger kept per run as state over micro-batches.

    Attempts of a run must reach it in order of ``seq`` across batches; within a batch they are sorted.
    """

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run = _Run(window, threshold)
        if state.exists:
            entries, recent = state.get
            for seg, e in (entries or {}).items():
                run.entries[seg] = {"status": e[0], "sig": (e[1], e[2], e[3]), "strikes": e[4], "hash": e[5], "demoted": e[6]}
            for r in recent or []:
                run.recent.append([r[0], None if r[1] is None else (r[1], r[2], r[3]), r[4]])
        pdf = pd.concat(list(batches)).sort_values("seq")
        out = [(key[0], r.seq, r.seg_id, *run.take(r.op, r.seg_id, (r.stage, r.error_class, r.code), r.input_hash)) for r in pdf.itertuples(index=False)]
        state.update((
            {s: (e["status"], *e["sig"], e["strikes"], e["hash"], e["demoted"]) for s, e in run.entries.items()},
            [(r[0], *(r[1] or (None, None, None)), r[2]) for r in run.recent],
        ))
        yield pd.DataFrame(out, columns=["run_id", "seq", "seg_id", "status", "aborted"])

    return attempts.groupBy("run_id").applyInPandasWithState(step, "run_id bigint, seq bigint, seg_id string, status string, aborted boolean", _STATE, "append", "NoTimeout")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Everything that has arrived, into parquet under ``out``; a restart from ``checkpoint`` writes nothing twice."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def upsert_available(stream: DataFrame, write, checkpoint: str) -> StreamingQuery:
    """Each micro-batch handed to ``write(df, batch_id)``, which must give the same result when a batch is repeated."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
