"""Failure ledger over ordered attempts: sliding windows in SQL, and the fold where an abort changes what follows.

Attempts hold ``run_id, seq, op, seg_id, stage, error_class, code, input_hash``. ``op`` is ``ok``,
``failure``, ``strike`` (counts in the window only), ``length_overflow`` or ``fit_overflow``.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WINDOW, THRESHOLD = 20, 5
#: Error classes that may end in giving a segment up.
GIVE_UP = ("content", "qa")


def window_strikes(attempts: DataFrame, window: int = WINDOW, threshold: int = THRESHOLD) -> DataFrame:
    """``run_id, seq, strikes, over``: failures with the signature of this one among the last ``window`` attempts of the run.

    Counted in a range frame per signature over the attempt's dense position, so runs with one
    signature throughout need no wider state than any other.
    """
    pos = F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))
    a = attempts.withColumn("pos", pos).where(F.col("op").isin("failure", "strike"))
    same = Window.partitionBy("run_id", "stage", "error_class", "code").orderBy("pos").rangeBetween(1 - window, 0)
    n = F.count(F.lit(1)).over(same)
    return a.select("run_id", "seq", n.alias("strikes"), (n >= threshold).alias("over"))


def escalations(attempts: DataFrame) -> DataFrame:
    """``run_id, seq, status, strikes``: status of each failure by the segment's failure before it, where nothing is demoted.

    A second content or QA failure with the same input gives the segment up (``accepted_skip``);
    an infrastructure failure on either side never does, nor a new input. Strikes count failures in
    a row with the same input.
    """
    # A success of the failed stage clears the entry, so the failure after it starts afresh; one of another stage leaves it.
    f = attempts.where("op in ('failure', 'ok')")
    entry = F.last(F.when(F.col("op") == "failure", F.coalesce("stage", F.lit(""))), True).over(Window.partitionBy("run_id", "seg_id").orderBy("seq"))
    f = f.withColumn("entry", entry).where((F.col("op") == "failure") | F.col("stage").isNull() | (F.col("stage") == F.col("entry")))
    f = f.withColumn("input_hash", F.when(F.col("op") == "failure", F.col("input_hash")))
    w = Window.partitionBy("run_id", "seg_id").orderBy("seq")
    same = F.coalesce(F.lag("input_hash").over(w) == F.col("input_hash"), F.lit(False))
    f = f.withColumn("same", same).withColumn("prev", F.lag("error_class").over(w)).withColumn("streak", F.sum((~same).cast("int")).over(w))
    f = f.withColumn("strikes", F.row_number().over(Window.partitionBy("run_id", "seg_id", "streak").orderBy("seq")))
    # Within a streak of equal input a pair of give-up failures escalates unless the one before already did.
    both = F.coalesce(F.col("same") & F.col("error_class").isin(*GIVE_UP) & F.col("prev").isin(*GIVE_UP), F.lit(False))
    own = Window.partitionBy("run_id", "seg_id").orderBy("seq")
    f = f.withColumn("pair", both).withColumn("chain", F.sum((~F.col("pair")).cast("int")).over(own))
    odd = (F.row_number().over(Window.partitionBy("run_id", "seg_id", "chain").orderBy("seq")) % 2) == 0
    f = f.withColumn("odd", odd).where("op = 'failure'")
    return f.select("run_id", "seq", F.when(F.col("pair") & F.col("odd"), "accepted_skip").otherwise("skipped").alias("status"), "strikes")


class _Run:
    """State of one run: the segments' entries and the last attempts."""

    def __init__(self, window: int, threshold: int):
        self.entries: dict[str, dict] = {}
        self.recent: deque = deque(maxlen=window)
        self.threshold = threshold

    def take(self, op: str, seg: str, sig: tuple, hash_: str) -> tuple[str | None, bool]:
        """(status of the segment after the attempt, whether it aborts the run)."""
        old = self.entries.get(seg)
        if op == "ok":
            if old and (sig[0] is None or old["sig"][0] == sig[0]):
                del self.entries[seg]
            self.recent.append([seg, None, False])
        elif op in ("length_overflow", "fit_overflow"):
            self.entries[seg] = {"status": op, "sig": ("tts" if op[0] == "l" else "fit", "length", op), "strikes": 0, "hash": "", "demoted": True}
            if op[0] == "l":
                self.recent.append([seg, self.entries[seg]["sig"], True])
        else:
            if op == "failure":
                again = bool(old) and old["hash"] == hash_
                give_up = again and old["status"] == "skipped" and not old["demoted"] and sig[1] in GIVE_UP and old["sig"][1] in GIVE_UP
                self.entries[seg] = {"status": "accepted_skip" if give_up else "skipped", "sig": sig, "strikes": old["strikes"] + 1 if again else 1, "hash": hash_, "demoted": False}
            self.recent.append([seg if op == "failure" else None, sig, False])
            hits = [r for r in self.recent if r[1] == sig and not r[2]]
            if len(hits) >= self.threshold:
                for r in hits:
                    r[2] = True
                    if r[0] in self.entries:
                        self.entries[r[0]]["demoted"] = True
                return self.entries.get(seg, {}).get("status"), True
        return self.entries.get(seg, {}).get("status"), False


def replay(attempts: DataFrame, window: int = WINDOW, threshold: int = THRESHOLD) -> DataFrame:
    """``run_id, seq, seg_id, status, aborted``: the ledger after every attempt, demotions included.

    An abort demotes the failures that caused it, so they neither count nor escalate again; the run
    goes on as a resumed one would. Attempts stream through sorted by run and sequence; only a run's
    state is held, never its attempts.
    """
    cols = ["run_id", "seq", "op", "seg_id", "stage", "error_class", "code", "input_hash"]
    rows = attempts.select(*cols).repartition("run_id").sortWithinPartitions("run_id", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for pdf in batches:
            out = []
            for run_id, seq, op, seg, stage, cls, code, hash_ in pdf.itertuples(index=False):
                if run_id != current:
                    current, state = run_id, _Run(window, threshold)
                out.append((run_id, seq, seg, *state.take(op, seg, (stage, cls, code), hash_)))
            yield pd.DataFrame(out, columns=["run_id", "seq", "seg_id", "status", "aborted"])

    return rows.mapInPandas(run, "run_id bigint, seq bigint, seg_id string, status string, aborted boolean")


def to_attempt(segments: DataFrame, entries: DataFrame) -> DataFrame:
    """Segments (``run_id, seg_id, input_hash``) but those given up on this very input."""
    done = entries.where("status = 'accepted_skip'").select("run_id", "seg_id", "input_hash")
    return segments.join(done, ["run_id", "seg_id", "input_hash"], "left_anti")


def reconcile_overflows(entries: DataFrame, overran: DataFrame) -> DataFrame:
    """Entries (``run_id, seg_id, status``) after a fit: stale ``fit_overflow`` ones go, new ones come where there is no entry, the rest stays.

    Doing it twice changes nothing more.
    """
    keys = ["run_id", "seg_id"]
    ids = overran.select(*keys).distinct()
    stale = entries.where("status = 'fit_overflow'").join(ids, keys, "left_anti").select(*keys)
    fresh = ids.join(entries.select(*keys), keys, "left_anti").withColumn("status", F.lit("fit_overflow"))
    return entries.select(*keys, "status").join(stale, keys, "left_anti").unionByName(fresh)


def save_entries(entries: DataFrame, path: str) -> None:
    """Entries by run: only the partitions of the runs at hand are replaced, each as a whole."""
    entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
