"""Mixing sources to target weights (problem 8): min-cost flow from membership patterns to source quotas.

Identical texts are one unit, a member of every source that carries it. Units are added up by
membership pattern; a flow network routes the tokens of each pattern, once per repetition level and
at a convex cost, to the quotas of the sources. The flow of every route becomes an interval of
token positions in a seeded order of the pattern's units, and the units in it are selected.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import spread, table

#: A public byte-level vocabulary as ranks, and the pattern that splits text before its merges.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED = 20_240
#: Seeded orders are cut into this many buckets, each ordered by itself.
BUCKETS = 4_096
#: Patterns and routes are solved on the driver. There can be as many patterns as sets of listed
#: sources; beyond this number the smallest ones are made simpler, see :func:`few_patterns`.
MOST_PATTERNS = 20_000

_TOKENIZERS: dict = {}


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _TOKENIZERS[path] = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _TOKENIZERS[path]


def source_name(c: Column) -> Column:
    """One spelling per source; null and blank stay null."""
    x = F.lower(F.trim(c))
    return F.when(x != "", x)


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, digest, n_tokens``; a null text counts as empty."""
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", source_name(F.col("source")).alias("source"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for b in batches:
            n = [len(t.encode_ordinary(x)) if x else 0 for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("digest"), pa.array(n, pa.int64())], ["doc_id", "source", "digest", "n_tokens"])

    return rows.mapInArrow(run, "doc_id bigint, source string, digest string, n_tokens bigint")


def units(sized: DataFrame, listed: list[str]) -> DataFrame:
    """``doc_id, n_docs, n_tokens, pattern``: one row per distinct text; pattern is its set of listed sources, joined by ``|``."""
    own = F.array_sort(F.collect_set(F.when(F.col("source").isin(listed), F.col("source"))))
    out = sized.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.countDistinct("doc_id").alias("n_docs"), F.max("n_tokens").alias("n_tokens"), own.alias("sources"))
    return out.select("doc_id", "n_docs", "n_tokens", F.array_join("sources", "|").alias("pattern"))


def kept(df: DataFrame) -> DataFrame:
    """The rows written once to the checkpoint folder of the session, so that several plans read them.

    Without such a folder a local session gets one under the warehouse folder; a cluster is refused,
    since a folder of one machine would be lost with it.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints")
    return df.checkpoint()


def few_patterns(u: DataFrame, targets: list, most: int = MOST_PATTERNS) -> tuple[DataFrame, dict[str, int]]:
    """The units and the tokens of each pattern, of at most ``most`` patterns and one for each source.

    The largest patterns stay. A unit of any other one counts as a member of only that source of its
    own which asks for most in proportion to what it has, so no unit is lost and quotas are filled as
    before; only among these units may another source have been the cheaper choice.
    """
    sums = u.where("pattern <> '' and n_tokens > 0").groupBy("pattern").agg(F.sum("n_tokens").alias("n"))
    top = {r[0]: r[1] for r in sums.orderBy(F.desc("n"), "pattern").limit(most + 1).collect()}
    if len(top) <= most:
        return u, top
    del top[max(top, key=lambda p: (-top[p], p))]
    have = {r[0]: r[1] for r in sums.select(F.explode(F.split("pattern", r"\|")).alias("s"), "n").groupBy("s").agg(F.sum("n")).collect()}
    asked = {s: max((r["size_ratio"] or 0) * (r["target_share"] or 0) for r in targets if r["source"] == s) for s in have}
    need = F.create_map(*[F.lit(x) for s in sorted(have) for x in (s, float(asked[s]) / have[s])])
    scarcest = F.array_max(F.transform(F.split("pattern", r"\|"), lambda s: F.struct(need[s].alias("need"), s.alias("s"))))["s"]
    stay = u.sparkSession.createDataFrame([(p, True) for p in top], "pattern string, _stays boolean")
    v = u.join(F.broadcast(stay), "pattern", "left").withColumn("pattern", F.when(F.col("_stays") | (F.col("pattern") == ""), F.col("pattern")).otherwise(scarcest)).drop("_stays")
    v = kept(v)
    return v, {r[0]: r[1] for r in v.where("pattern <> '' and n_tokens > 0").groupBy("pattern").agg(F.sum("n_tokens")).collect()}


# -- flow ------------------------------------------------------------------------------------------------


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each arc (from, to, capacity, cost) of a maximal flow of least cost: successive shortest paths."""
    graph: list[list[int]] = [[] for _ in range(n)]
    to, cap, cost = [], [], []
    for a, b, c, w in arcs:
        for x, y, k, z in ((a, b, c, w), (b, a, 0, -w)):
            graph[x].append(len(to))
            to.append(y)
            cap.append(k)
            cost.append(z)
    while True:
        dist: list[float] = [float("inf")] * n
        dist[source] = 0
        via = [-1] * n
        queue, queued = [source], {source}
        while queue:
            x = queue.pop(0)
            queued.discard(x)
            for e in graph[x]:
                if cap[e] > 0 and dist[x] + cost[e] < dist[to[e]]:
                    dist[to[e]] = dist[x] + cost[e]
                    via[to[e]] = e
                    if to[e] not in queued:
                        queue.append(to[e])
                        queued.add(to[e])
        if via[sink] < 0:
            return [cap[2 * i + 1] for i in range(len(arcs))]
        push, x = float("inf"), sink
        while x != source:
            push = min(push, cap[via[x]])
            x = to[via[x] ^ 1]
        x = sink
        while x != source:
            cap[via[x]] -= push
            cap[via[x] ^ 1] += push
            x = to[via[x] ^ 1]


def routes(patterns: dict[str, int], quotas: dict[str, int], repeats: dict[str, int]) -> list[tuple[str, int, str, int]]:
    """(pattern, level, source, tokens): level r is the r-th use of a unit and costs r squared, so early levels fill first."""
    names = [(p, r) for p in sorted(patterns) for r in range(1, max((repeats[s] for s in p.split("|") if s in repeats), default=0) + 1)]
    sources = sorted(quotas)
    at = {x: i for i, x in enumerate(names)} | {s: len(names) + i for i, s in enumerate(sources)}
    n = len(at) + 2
    arcs, real = [], []
    for p, r in names:
        arcs.append((n - 2, at[p, r], patterns[p], r * r))
        real.append(None)
        for s in p.split("|"):
            if s in quotas and r <= repeats[s]:
                arcs.append((at[p, r], at[s], patterns[p], 0))
                real.append((p, r, s))
    for s in sources:
        arcs.append((at[s], n - 1, quotas[s], 0))
        real.append(None)
    flow = min_cost_flow(n, arcs, n - 2, n - 1)
    return [(*x, f) for x, f in zip(real, flow) if x and f > 0]


# -- selection -------------------------------------------------------------------------------------------


def positions(u: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``pos``: the tokens of the pattern's units before this one in the seeded order.

    The order is by a hash; tokens are added up per hash bucket, the running sum over buckets gives
    each bucket its offset, and only units of one bucket are ordered together.
    """
    h = u.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("_bucket", F.pmod(F.shiftrightunsigned("_h", 40), F.lit(BUCKETS)))
    sums = h.groupBy("pattern", "_bucket").agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy("pattern").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("pattern", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("pattern", "_bucket").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = h.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return placed.join(offsets, ["pattern", "_bucket"]).withColumn("pos", F.col("offset") + F.col("_in")).drop("_h", "_bucket", "_in", "offset")


def mix(docs: DataFrame, targets: DataFrame, path: str = TOKENIZER, seed: int = SEED) -> DataFrame:
    """``mix_id, doc_id, source, uses, n_tokens``: the units of every mix and how often each source uses them.

    A quota is the target share of ``size_ratio`` times the tokens of all documents. A source that
    is too small even when repeated falls short and keeps its place at ``max_repeats``; nothing else
    fills it up, so shares reached may differ from targets. A unit is used at most as often as the
    most repeated of its sources allows, by each source at most ``max_repeats`` times. Null, blank
    and unlisted sources and empty texts are in the corpus size but in no mix.
    """
    wanted = targets.select("mix_id", source_name(F.col("source")).alias("source"), "target_share", "max_repeats", "size_ratio").where("source is not null").collect()
    listed = sorted({r["source"] for r in wanted})
    u = kept(units(token_counts(docs, path), listed))
    total = u.agg(F.sum(F.col("n_tokens") * F.col("n_docs"))).first()[0] or 0
    u, patterns = few_patterns(u, wanted)
    spans = []
    for m in sorted({r["mix_id"] for r in wanted}):
        own = [r for r in wanted if r["mix_id"] == m]
        quotas = {r["source"]: round(total * (r["size_ratio"] or 0) * (r["target_share"] or 0)) for r in own}
        filled: dict[tuple[str, int], int] = defaultdict(int)
        for p, r, s, f in sorted(routes(patterns, quotas, {x["source"]: x["max_repeats"] or 0 for x in own})):
            spans.append((m, p, r, s, filled[p, r], filled[p, r] + f))
            filled[p, r] += f
    spark = docs.sparkSession
    plan = spark.createDataFrame(spans, "mix_id int, pattern string, level int, source string, lo bigint, hi bigint")
    placed = positions(u.where("pattern <> '' and n_tokens > 0"), seed)
    mid = F.col("pos") + F.col("n_tokens") / 2
    chosen = placed.join(plan, "pattern").where((mid >= F.col("lo")) & (mid < F.col("hi")))
    return chosen.groupBy("mix_id", "doc_id", "source").agg(F.count(F.lit(1)).cast("int").alias("uses"), F.first("n_tokens").alias("n_tokens"))


def shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """``mix_id, source, target_share, n_tokens, actual_share, n_docs, most_uses`` of every mix and source."""
    got = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("n_tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("uses").alias("most_uses"))
    asked = targets.select("mix_id", source_name(F.col("source")).alias("source"), "target_share")
    out = asked.join(got, ["mix_id", "source"], "left").na.fill(0, ["n_tokens", "n_docs", "most_uses"])
    return out.withColumn("actual_share", F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy("mix_id")))


def _mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(spread(table(spark, d, "documents", "doc_id", "source", "text")), table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(_mix(spark, d), table(spark, d, "mix_targets"))


QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares}
ORACLES: dict[str, str] = {}
