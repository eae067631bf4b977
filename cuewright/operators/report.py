"""Per-run reports from durable rows: tallies, partitions, precedence and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def current_segments(manifests: DataFrame) -> DataFrame:
    """``run_id, seg_id`` of the first stage that lists any segments: translate, then crosscheck, then asr.

    ``manifests`` holds ``run_id, stage, seg_id``.
    """
    rank = F.when(F.col("stage") == "translate", 0).when(F.col("stage") == "crosscheck", 1).when(F.col("stage") == "asr", 2)
    m = manifests.where(F.col("seg_id").isNotNull()).withColumn("rank", rank).where("rank is not null")
    best = Window.partitionBy("run_id")
    return m.withColumn("first", F.min("rank").over(best)).where("rank = first").select("run_id", "seg_id").distinct()


def verdict_tallies(verdicts: DataFrame) -> DataFrame:
    """Counts per run by decision (all that is neither replace nor subtitle is keep) and by mark."""
    d = F.col("decision")
    is_ = lambda c: F.coalesce(c, F.lit(False))
    return verdicts.groupBy("run_id").agg(
        F.count_if(is_(d == "replace")).alias("n_replace"), F.count_if(is_(d == "subtitle")).alias("n_subtitle"), F.count_if(~is_(d.isin("replace", "subtitle"))).alias("n_keep"),
        F.count_if(is_(F.col("contested"))).alias("n_contested"), F.count_if(is_(F.col("low_confidence"))).alias("n_low_confidence"),
        F.count_if(is_((d == "replace") & (F.col("source") == "fallback"))).alias("n_fallback"))


def winners(verdicts: DataFrame) -> DataFrame:
    """``run_id, by_engine``: replacements per winning side as a map; runs without any have an empty one."""
    n = verdicts.where("decision = 'replace'").groupBy("run_id", F.coalesce("winners", F.lit("")).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    maps = n.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("w", "n")))).alias("by_engine"))
    runs = verdicts.select("run_id").distinct()
    return runs.join(maps, "run_id", "left").withColumn("by_engine", F.coalesce("by_engine", F.create_map().cast("map<string,bigint>")))


def first_keywords(verdicts: DataFrame, order: str) -> DataFrame:
    """``run_id, keywords``: the first non-empty list in order."""
    return verdicts.where(F.size("keywords") > 0).groupBy("run_id").agg(F.min_by("keywords", order).alias("keywords"))


def entry_counts(entries: DataFrame) -> DataFrame:
    """Ledger entries per run and status."""
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return entries.groupBy("run_id").agg(*map(n, ("skipped", "accepted_skip", "length_overflow", "fit_overflow")))


def run_reports(runs: DataFrame, entries: DataFrame, tallies: DataFrame) -> DataFrame:
    """One row per run: entry counts, verdict tallies and the exit code.

    ``runs`` holds ``run_id, state``. Code 3 for aborted, 1 for failed, 2 if any segment was skipped,
    given up or cut to fit, else 0; length overflows do not count.
    """
    r = runs.join(entry_counts(entries), "run_id", "left").join(tallies, "run_id", "left")
    r = r.na.fill(0, [c for c in r.columns if c.startswith("n_")])
    code = F.when(F.col("state") == "aborted", 3).when(F.col("state") == "failed", 1).when(F.col("n_skipped") + F.col("n_accepted_skip") + F.col("n_fit_overflow") > 0, 2).otherwise(0)
    return r.withColumn("exit_code", code)


def full_reports(runs: DataFrame, entries: DataFrame, verdicts: DataFrame, current: DataFrame, overrides: DataFrame, timings: DataFrame, marks: DataFrame) -> DataFrame:
    """One row per run: status, config, entries by status, verdict lists and tallies, degraded stages, overrides, timings, abort and exit code.

    ``runs`` holds ``run_id, state, abort`` and a struct ``config``; ``marks`` holds ``run_id, stage,
    reason`` of stages that fell short; ``current`` the segments that count (``run_id, seg_id``). A
    run without current segments is reported with all of its entries. Lists are sorted.
    """
    known = current.select("run_id").distinct().withColumn("_known", F.lit(True))

    def valid(df):
        """The rows of current segments; all rows of runs of which none is known."""
        marked = df.join(current.select("run_id", "seg_id").distinct().withColumn("_now", F.lit(True)), ["run_id", "seg_id"], "left").join(known, "run_id", "left")
        return marked.where(F.col("_now").isNotNull() | F.col("_known").isNull()).drop("_now", "_known")

    def listed(df, when, what, name):
        return df.groupBy("run_id").agg(F.array_sort(F.array_compact(F.collect_list(F.when(when, what)))).alias(name))

    e, v = valid(entries), valid(verdicts)
    status = F.col("status")
    lists = [listed(e, status == s, F.col("seg_id"), name) for s, name in (("skipped", "skipped"), ("accepted_skip", "accepted_skips"), ("length_overflow", "length_overflows"), ("fit_overflow", "fit_overflows"))]
    lists += [listed(v, F.col("decision") == "replace", F.col("seg_id"), "replacements"), listed(v, F.col("low_confidence"), F.col("seg_id"), "low_confidence")]
    o = override_status(overrides, current).join(known, "run_id", "left").withColumn("applied", F.col("applied") | F.col("_known").isNull())
    lists += [listed(o, F.col("applied"), F.col("seg_id"), "overrides_applied"), listed(o, ~F.col("applied"), F.col("seg_id"), "overrides_unmatched")]
    lists += [listed(marks, F.lit(True), F.struct("stage", "reason"), "degraded"), listed(stage_seconds(timings), F.lit(True), F.struct("stage", "seconds"), "timings")]
    out = run_reports(runs, e, verdict_tallies(v)).join(winners(v), "run_id", "left")
    for x in lists:
        out = out.join(x, "run_id", "left")
    empty = {x.columns[1]: F.array().cast(x.schema[1].dataType) for x in lists}
    return out.withColumns({n: F.coalesce(n, none) for n, none in empty.items()}).withColumn("by_engine", F.coalesce("by_engine", F.create_map().cast("map<string,bigint>")))


def detection_marks(detected: DataFrame, stage: str = "asr") -> DataFrame:
    """``run_id, stage, reason``: a mark of every run whose language is mixed (``run_id, lang, mixed``); a run that is not loses its mark by having no row."""
    return detected.where("mixed").select("run_id", F.lit(stage).alias("stage"), F.concat(F.lit("detected "), F.coalesce("lang", F.lit("unknown"))).alias("reason"))


def changed_runs(now: DataFrame, before: DataFrame) -> DataFrame:
    """``run_id`` of the runs whose key (``run_id, fingerprint``) is not the one before; what is derived from them is made anew."""
    return now.join(before.select("run_id", "fingerprint").distinct(), ["run_id", "fingerprint"], "left_anti").select("run_id").distinct()


def stage_seconds(timings: DataFrame) -> DataFrame:
    """``run_id, stage, seconds`` summed over repeated stages."""
    return timings.groupBy("run_id", "stage").agg(F.round(F.sum("elapsed_s"), 2).alias("seconds"))


def endpoint_models(needs: DataFrame) -> DataFrame:
    """``host, api_key, models``: the models each endpoint has to serve, sorted."""
    return needs.groupBy("host", "api_key").agg(F.array_sort(F.collect_set("model")).alias("models"))


def apply_overrides(segments: DataFrame, overrides: DataFrame) -> DataFrame:
    """``run_id, idx, text, skipped, reason``: the override, else the source of a same-language run, else the translation.

    ``segments`` holds ``run_id, idx, text_src, translated, same_language``; ``overrides`` holds
    ``run_id, seg_id, text``, blank texts not counting. Without any text a line is skipped.
    """
    from ..functions.text import strip

    o = overrides.where(strip(F.col("text")) != "").select("run_id", "seg_id", F.col("text").alias("override"))
    s = segments.withColumn("seg_id", F.format_string("seg_%04d", "idx")).join(o, ["run_id", "seg_id"], "left")
    text = F.coalesce("override", F.when(F.col("same_language"), F.col("text_src")).otherwise(F.col("translated")))
    empty = F.coalesce(strip(text) == "", F.lit(True))
    return s.select("run_id", "idx", F.when(~empty, text).alias("text"), empty.alias("skipped"), F.when(empty, "translate_failed").otherwise("").alias("reason"))


def override_status(overrides: DataFrame, valid: DataFrame) -> DataFrame:
    """``run_id, seg_id, applied``: whether an override's key is a current segment."""
    hit = valid.select("run_id", "seg_id").distinct().withColumn("_hit", F.lit(True))
    return overrides.select("run_id", "seg_id").join(hit, ["run_id", "seg_id"], "left").select("run_id", "seg_id", F.coalesce("_hit", F.lit(False)).alias("applied"))


def bad_override_keys(overrides: DataFrame, counts: DataFrame) -> DataFrame:
    """Keys that are no ``seg_<number>`` or whose number is not below the run's ``n`` segments; an unpadded number passes."""
    number = F.regexp_extract("seg_id", r"^seg_([0-9]+)$", 1)
    j = overrides.join(counts.select("run_id", "n"), "run_id", "left")
    return j.where((number == "") | (F.try_to_number(number, F.lit("9" * 18)).cast("bigint") >= F.coalesce("n", F.lit(0)))).select("run_id", "seg_id")


def problems(*checks: DataFrame) -> DataFrame:
    """``subject, problem`` of all checks together, each once: everything is gathered before anything fails."""
    found = checks[0].select("subject", "problem")
    for c in checks[1:]:
        found = found.unionByName(c.select("subject", "problem"))
    return found.distinct()


def summary_lines(reports: DataFrame) -> DataFrame:
    """``run_id, report, summary``: a run's report as JSON and as one line for people."""
    counts = [c for c in reports.columns if c.startswith("n_")]
    named = [F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(" " + c[2:].replace("_", " ")))) for c in counts]
    line = F.concat(F.col("state"), F.lit(", exit "), F.col("exit_code").cast("string"), F.when(F.concat_ws("", *named) != "", F.concat(F.lit(": "), F.concat_ws(", ", *named))).otherwise(F.lit("")))
    return reports.select("run_id", F.to_json(F.struct(*[c for c in reports.columns])).alias("report"), line.alias("summary"))
