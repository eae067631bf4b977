"""Rounds of rework over the rows that still miss a bound, with outside functions for the work itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rework(rows: DataFrame, misses: Column, redo: Callable[[DataFrame, int], DataFrame], rounds: int = 2) -> DataFrame:
    """All rows after at most ``rounds`` rounds: those that miss the bound go through ``redo(rows, round)`` again.

    ``redo`` keeps the columns. Rows that are done are set aside before each round, so the outside
    function sees only what is left; ``n_rounds`` tells how often a row was redone.
    """
    open_ = rows.withColumn("n_rounds", F.lit(0))
    done = None
    for k in range(rounds):
        bad = F.coalesce(misses, F.lit(False))
        good = open_.where(~bad)
        done = good if done is None else done.unionByName(good)
        open_ = redo(open_.where(bad), k + 1).withColumn("n_rounds", F.lit(k + 1))
    return open_ if done is None else done.unionByName(open_)
