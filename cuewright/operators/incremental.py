"""Content-addressed recomputation: what is valid, what must be computed, what can be reused."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def todo(inputs: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs (``keys, fingerprint``) without a finalized entry of the same fingerprint, and those whose entry may be retried."""
    valid = manifest.where(F.col("finalized") & ~F.coalesce("retryable", F.lit(False)))
    return inputs.join(valid.select(*keys, "fingerprint").distinct(), [*keys, "fingerprint"], "left_anti")


def load_or_compute(inputs: DataFrame, manifest: DataFrame, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Outputs of all inputs: valid ones from the manifest (``keys, fingerprint, output``), the rest by ``compute``.

    ``compute`` sees only the rows to do and gives ``keys, fingerprint, output``.
    """
    pending = todo(inputs, manifest, keys)
    valid = manifest.where(F.col("finalized") & ~F.coalesce("retryable", F.lit(False)))
    reused = inputs.select(*keys, "fingerprint").join(valid.select(*keys, "fingerprint", "output").dropDuplicates([*keys, "fingerprint"]), [*keys, "fingerprint"])
    return reused.withColumn("reused", F.lit(True)).unionByName(compute(pending).select(*keys, "fingerprint", "output").withColumn("reused", F.lit(False)))


def missing_outputs(jobs: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Jobs that a worker gave no output for."""
    return jobs.join(outputs.select(*keys), keys, "left_anti")


def batch_plan(lines: DataFrame, previous: DataFrame, size: int) -> DataFrame:
    """``run_id, idx, batch, batch_valid, reuse``: which lines a rerun of batches has to redo.

    Lines and previous results hold ``run_id, idx, line_key``. A batch is valid if all of its lines
    are unchanged; in an invalid one an unchanged line is reused and only the others are redone.
    """
    w = Window.partitionBy("run_id").orderBy("idx")
    x = lines.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("int"))
    old = previous.select("run_id", "idx", F.col("line_key").alias("old_key"))
    same = F.coalesce(F.col("line_key") == F.col("old_key"), F.lit(False))
    y = x.join(old, ["run_id", "idx"], "left").withColumn("same", same)
    valid = F.min(F.col("same").cast("int")).over(Window.partitionBy("run_id", "batch")) == 1
    return y.select("run_id", "idx", "batch", valid.alias("batch_valid"), F.col("same").alias("reuse"))


def ordered_fingerprint(rows: DataFrame, keys: list[str], order: str, entry: Column, version: str) -> DataFrame:
    """``keys, fingerprint``: one hash over a key's entries in order, with a policy version."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), entry.alias("e")))), lambda x: x["e"])
    return rows.groupBy(*keys).agg(F.sha2(F.concat(F.lit(version + "\n"), F.concat_ws("\n", listed)), 256).alias("fingerprint"))


def hash_chain(rows: DataFrame, key: str, order: str, own: str) -> DataFrame:
    """``key, order, chain``: each link hashes its own content and the link before it, so an edit changes the links from there on only."""
    per = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(own).alias("h")))).alias("xs"))
    zero = F.struct(F.lit("").alias("last"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        h = F.sha2(F.concat(acc["last"], F.lit(":"), x["h"]), 256)
        return F.struct(h.alias("last"), F.concat(acc["out"], F.array(h)).alias("out"))

    chained = per.withColumn("cs", F.aggregate("xs", zero, step, lambda acc: acc["out"]))
    return chained.select(key, F.explode(F.arrays_zip("xs", "cs")).alias("z")).select(key, F.col("z.xs.o").alias(order), F.col("z.cs").alias("chain"))


def manifest_rows(outputs: DataFrame, keys: list[str], stage: str, finalized: Column | None = None) -> DataFrame:
    """Manifest entries of outputs (``keys, fingerprint, output``): hash, size and time, to be appended to the manifest.

    An output that is not ``finalized`` is durable but stays to be done again.
    """
    done = F.lit(True) if finalized is None else F.coalesce(finalized, F.lit(False))
    return outputs.select(
        *keys, F.lit(stage).alias("stage"), "fingerprint", F.sha2("output", 256).alias("output_sha256"), F.octet_length("output").alias("size"), F.current_timestamp().alias("written_at"), done.alias("finalized"), "output")
