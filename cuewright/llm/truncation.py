"""Values cut off by a field limit or in mid-transfer (problem 6).

Positives are made by cutting intact values; a hashed logistic regression is fitted on how a value
closes: its last words and characters, the mark at its end, open quotations, and whether its length
is a limit of its source. Every value is then scored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import delivered_once, table
from . import marks as M
from .sentences import _STRIP, _compact, _fillers_only_text, _only_fillers, _open_quotes, bare, norm

FIELDS = ["text_src", "text_target"]
#: Bound of the labelled sample (values of each field) and size of the hashed weight vector.
SAMPLE_VALUES = 8_000
BITS = 18
#: A length is a limit if it holds at least LIMIT_LEAST values of a source and LIMIT_TIMES the mean
#: of the LIMIT_SPAN lengths on either side.
LIMIT_LEAST, LIMIT_TIMES, LIMIT_SPAN = 10, 8.0, 12

_CUT_ESCAPE = re.compile(r"&(?:#?\w{0,7})?$")
_ENDED = re.compile(rf"[{re.escape(M.ENDERS)}]+[\s\"'”’“»)\]」』】）]*$")
_TRAIL = re.compile(r"(?:…|\.{2,})[\s\"'”’“»)\]」』】）]*$")
_AMBIGUOUS = re.compile(rf"(?:[{re.escape(M.ENDERS)}][\s\"'”’“»)\]」』】）]*|[\[(<*♪【（{{][^\])>*♪】）}}]*)$")


@dataclass
class Model:
    weights: np.ndarray
    words: frozenset[str]
    threshold: float


def _h(feature: str) -> int:
    return zlib.crc32(feature.encode()) & ((1 << BITS) - 1)


def features(text: str, limits: tuple[int, ...], words: frozenset[str]) -> list[int] | None:
    """Hashed features of how a value closes; None if nothing but fillers is said in it."""
    plain, _ = M.unescape(text)
    said = M.speech(plain)
    tail = said.rstrip()
    if not tail.strip(_STRIP) or _only_fillers(tail.split()) or _fillers_only_text(tail):
        return None
    unspaced = M.is_unspaced(said)
    is_bare = bare(said)
    style = ("C" if unspaced else "W") + ("b" if is_bare else "m")
    last = tail[-1]
    if _TRAIL.search(tail):
        end = "t"
    elif _ENDED.search(tail):
        end = "e"
    elif last in M.CLOSERS + "“":
        end = "c"
    elif last in M.INNER_MARKS:
        end = ","
    elif last.isdigit():
        end = "9"
    elif last.isalpha() or not last.isascii():
        end = "a"
    else:
        end = "-"
    f = ["b" + style, "e" + style + end]
    if text[-1:].isspace() and not said[-1:].isspace() or text != text.rstrip():
        f.append("space" + end)
    chars, size = len(text), len(text.encode())
    at = "l" if chars in limits[0] or any(b - 4 < size <= b + 2 for b in limits[1]) else "n" if any(0 < n - chars <= 3 for n in limits[0]) else ""
    f.append("at" + at + end)
    if "�" in tail[-3:] or _CUT_ESCAPE.search(text[-10:]):
        f.append("broken")
    core = re.sub(r"(?:…|\.{2,})$", "", tail).rstrip(_STRIP) if end == "t" else tail.rstrip(_STRIP)
    sentence = re.split(r"(?<=[.!?…。！？])[\"'”’»)\]」』）]*\s+(?=\S)|(?<=[。！？])[”」』]?", core[-400:])[-1]
    f.append(f"open{min(_open_quotes(tail), 2)}{end}")
    if any(tail.rfind(o) > tail.rfind(c) for o, c in ("[]", "()", "（）", "【】")):
        f.append("bracket")
    if unspaced:
        letters, _ = _compact(core[-80:])
        f += [f"z{k}{end}" + letters[-k:] for k in (1, 2, 3, 4, 5, 6, 8)]
        f += [f"y{k}{is_bare:d}" + letters[-k:] for k in (2, 4, 6, 8)]
        f.append(f"n{min(len(_compact(sentence)[0]) // 6, 6)}{end}C")
        latin = re.search(r"[A-Za-z][\w.-]*$", core)
        if latin:
            f.append("latin" + ("k" if norm(latin.group()) in words else "u") + end)
    else:
        raw = core.split()
        ws = [norm(t) for t in raw[-4:]]
        w = [x if x in words else "<r>" for x in ws]
        w = [""] * (3 - len(w)) + w[-3:] if len(w) < 3 else w[-3:]
        cap = raw and raw[-1][:1].isupper()
        known = "k" if ws and ws[-1] in words else "9" if ws and ws[-1] and not any(c.isalpha() for c in ws[-1]) else "U" if cap else "u"
        for tag in (end, ""):
            f += [f"1{tag}" + w[-1], f"2{tag}" + " ".join(w[-2:]), f"3{tag}" + " ".join(w[-3:])]
        f += [f"k{known}{end}{style}", f"kl{known}{end}{at}"]
        f += [f"s{k}{known}" + core[-k:].lower() for k in (2, 3, 4)]
        f.append(f"n{min(len(sentence.split()) // 3, 6)}{end}W{is_bare:d}")
    return [_h(x) for x in f]


def _strip_end(text: str) -> str:
    """The value without its last sentence mark; closing quotes that follow it go too."""
    return re.sub(rf"[{re.escape(M.ENDERS)}]+([\"'”’“»)\]」』）]*)\s*$", r"\1", text.rstrip())


def _bare_form(text: str) -> str:
    return " ".join(w for w in (t.strip(_STRIP) for t in text.lower().split()) if w) if not M.is_unspaced(text) else re.sub(r"[、，；：。！？…“”「」]+", "", text.lower())


def fit(values: list[tuple[str, tuple]], seed: int = 11) -> Model:
    """Fit on (value, limits of its source and field); values that look cut themselves are left out of the intact ones."""
    rng = random.Random(seed)
    counts: Counter = Counter()
    for text, _ in values:
        said = M.speech(M.unescape(text)[0])
        counts.update({norm(t) for t in said.split()[:-1]} if not M.is_unspaced(said) else {norm(t) for t in re.findall(r"[A-Za-z][\w.-]*(?=.)", said[:-12])})
    words = frozenset(w for w, c in counts.items() if c >= 2 and w)
    rows: list[tuple[list[int], int, float]] = []
    known = sorted({x for _, x in values if x[0] or x[1]}, key=lambda x: (sorted(x[0]), sorted(x[1])))

    def add(text: str, limits: tuple, label: int, weight: float) -> None:
        f = features(text, limits, words)
        if f:
            rows.append((f, label, weight))

    for text, limits in values:
        said = M.speech(M.unescape(text)[0]).rstrip()
        if not said.strip(_STRIP):
            continue
        n, size = len(text), len(text.encode())
        thai = M.SPACED_SENTENCES.search(said) is not None
        unmarked = thai or bare(said)
        at_limit = n in limits[0] or any(b - 4 < size <= b + 2 for b in limits[1])
        if at_limit or not (unmarked or _ENDED.search(said)):
            continue  # perhaps cut: neither intact nor a source of cuts
        add(text, limits, 0, 1.0)
        if not unmarked:
            add(_strip_end(text), limits, 0, 0.7)
            if rng.random() < 0.3:
                b = _bare_form(said)
                add(b, limits, 0, 0.7)
                if len(b) > 12:
                    _cut(b, limits, rng, add, thai)
        if n > 12:
            for _ in range(2):
                _cut(text, limits, rng, add, thai)
            # A limited field holds no value over its limit, so values of other fields are cut at it.
            for other in rng.sample(known, min(2, len(known))):
                _cut_to(text, n, size, other, rng, add, thai)
    return _solve(rows, words)


def _cut(text: str, limits: tuple, rng: random.Random, add, thai: bool) -> None:
    # Cuts near the end matter most: there the rest is short.
    n = len(text)
    k = rng.randrange(4, n - 1) if rng.random() < 0.6 else n - rng.randrange(2, min(n - 4, 40) + 1)
    if rng.random() < 0.35:  # between words
        s = text.rfind(" ", 4, k)
        k = s if s > 0 else k
    _cut_at(text, k, limits, rng, add, thai)


def _cut_to(text: str, n: int, size: int, limits: tuple, rng: random.Random, add, thai: bool) -> None:
    for k in sorted(limits[0]):
        if k < n:
            if rng.random() < 0.4:  # some fields end cut values with an ellipsis inside the limit
                _cut_at(text, k - 1, limits, rng, add, thai, mark="…")
            else:
                _cut_at(text, k, limits, rng, add, thai)
    for k in sorted(limits[1]):
        if k < size:
            t = text.encode()[:k].decode(errors="ignore" if rng.random() < 0.5 else "replace")
            _cut_at(text, len(t), limits, rng, add, thai, t)


def _cut_at(text: str, k: int, limits: tuple, rng: random.Random, add, thai: bool, head: str | None = None, mark: str = "") -> None:
    head = text[:k] if head is None else head
    rest = text[k:]
    if not rest.strip(_STRIP) or _AMBIGUOUS.search(head.rstrip()) or (thai and rest[:1].isspace()):
        return
    if head != head.rstrip() and _AMBIGUOUS.search(head.rstrip()[-1:]):
        return
    if not mark and rng.random() < 0.04:
        mark = rng.choice(("…", "..."))
    add(head + mark, limits, 1, 1.0)


def _solve(rows: list[tuple[list[int], int, float]], words: frozenset[str], rounds: int = 80, l2: float = 0.5, prior: float = 0.08) -> Model:
    """Weighted logistic regression by AdaGrad; the threshold keeps the error rates in balance at ``prior``."""
    if not rows:
        return Model(np.zeros(1 << BITS), words, 0.0)
    order = list(range(len(rows)))
    random.Random(5).shuffle(order)
    held = set(order[: len(order) // 6])
    train = [i for i in order if i not in held]
    r = np.concatenate([np.full(len(rows[i][0]), k) for k, i in enumerate(train)])
    c = np.concatenate([np.asarray(rows[i][0]) for i in train])
    y = np.asarray([rows[i][1] for i in train], dtype=float)
    weight = np.asarray([rows[i][2] for i in train])
    w = np.zeros(1 << BITS)
    g2 = np.full(1 << BITS, 1e-3)
    for step in range(rounds):
        z = np.bincount(r, weights=w[c], minlength=len(y))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(c, weights=((p - y) * weight)[r], minlength=1 << BITS) + l2 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2) / (1 + step / rounds)
    scored = sorted(((float(w[rows[i][0]].sum()), rows[i][1]) for i in held), reverse=True)
    pos = max(1, sum(y for _, y in scored))
    neg = max(1, len(scored) - pos)
    best, threshold, tp, fp = -1.0, 0.0, 0, 0
    for k, (s, y1) in enumerate(scored):
        tp, fp = tp + y1, fp + 1 - y1
        hit, wrong = prior * tp / pos, (1 - prior) * fp / neg
        f1 = 2 * hit / (hit + wrong + prior)
        if f1 > best:
            best, threshold = f1, (s + scored[k + 1][0]) / 2 if k + 1 < len(scored) else s
    return Model(w, words, threshold)


# -- DataFrame operators -----------------------------------------------------------------------------


def value_sizes(df: DataFrame, keys: list[str], source: str, fields: list[str]) -> DataFrame:
    """``source, field, unit, size`` of every non-null value, a row delivered twice counted once; the texts themselves are not shuffled."""
    unit = lambda f, u, size: F.when(F.col(f).isNotNull(), F.struct(F.lit(f).alias("field"), F.lit(u).alias("unit"), size(f).alias("size")))
    sizes = F.array(*[unit(f, u, size) for f in fields for u, size in (("char", F.length), ("byte", F.octet_length))])
    once = delivered_once(df.select(*keys, source, "loaded_at", sizes.alias("sizes")), *keys)
    return once.select(source, F.explode(F.array_compact("sizes")).alias("s")).select(source, "s.*")


def field_limits(sizes: DataFrame, source: str) -> DataFrame:
    """``source, field, unit, size``: lengths at which many values of a source stop, in ``char`` or ``byte``.

    Computed over all values of :func:`value_sizes`: a histogram of lengths (partial counts before the
    shuffle) and, per length, the mean count of its neighbourhood. Null sources are a source of their own.
    """
    hist = sizes.groupBy(source, "field", "unit", "size").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(source, "field", "unit").orderBy("size")
    near = F.sum("n").over(w.rangeBetween(-LIMIT_SPAN, LIMIT_SPAN))
    top = F.col("n") >= F.greatest(F.lit(LIMIT_LEAST), LIMIT_TIMES * (F.col("near") - F.col("n")) / (2 * LIMIT_SPAN))
    return hist.withColumn("near", near).where(top & (F.col("size") >= 20)).select(source, "field", "unit", "size")


def _limits_map(rows: list) -> dict:
    found: dict = {}
    for source, f, unit, size in rows:
        found.setdefault((source, f), (set(), set()))[unit == "byte"].add(size)
    # A byte limit is meant only where no limit in characters explains it.
    return {k: (frozenset(c), frozenset(b) if not c else frozenset()) for k, (c, b) in found.items()}


#: Up to so many limits travel to the workers as a map; more of them are joined to the rows.
MOST_LIMITS = 20_000
#: Tasks over which the rows of one source are spread in that join.
SPREAD = 32
_NONE = (frozenset(), frozenset())


def fit_model(spark: SparkSession, d: str, most: int = SAMPLE_VALUES) -> tuple[Model, dict | DataFrame]:
    """The model, and all limits: a map, or the rows of :func:`field_limits` where they are many."""
    segments = table(spark, d, "segments", "run_id", "idx", "text_src", "text_target", "feed", "loaded_at")
    limits = field_limits(value_sizes(segments, ["run_id", "idx"], "feed", FIELDS), "feed")
    few = limits.limit(MOST_LIMITS + 1).collect()
    rows = segments.select("feed", *FIELDS, F.xxhash64("run_id", "idx").alias("_h")).orderBy("_h", *FIELDS).limit(most).collect()
    if len(few) <= MOST_LIMITS:
        limits = known = _limits_map(few)
    else:
        feeds = spark.createDataFrame([(f,) for f in {r["feed"] for r in rows}], "_feed string")
        known = _limits_map(limits.join(F.broadcast(feeds), F.col("feed").eqNullSafe(F.col("_feed"))).drop("_feed").collect())
    return fit([(r[f], known.get((r["feed"], f), _NONE)) for r in rows for f in FIELDS if r[f]]), limits


def with_limits(df: DataFrame, limits: dict | DataFrame, keys: list[str], source: str) -> tuple[DataFrame, dict | None]:
    """The rows and the map of limits; without a map the rows have the limits of their source in ``_limits``."""
    if isinstance(limits, dict):
        return df, limits
    of = limits.groupBy(F.col(source).alias("_source")).agg(F.collect_list(F.struct("field", "unit", "size")).alias("_limits"))
    of = of.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    rows = df.withColumn("_at", F.pmod(F.xxhash64(*keys), F.lit(SPREAD)).cast("int"))
    return rows.join(of, F.col(source).eqNullSafe(F.col("_source")) & (F.col("_at") == F.col("_part")), "left").drop("_source", "_part", "_at"), None


def limits_of(b: pa.RecordBatch, source: str, known: dict | None):
    """(row, field) -> limits, for a batch of :func:`with_limits`."""
    sources = b.column(source).to_pylist()
    if known is not None:
        return lambda i, f: known.get((sources[i], f), _NONE)
    column, maps = b.column("_limits"), {}

    def of(i: int, f: str) -> tuple:
        s = sources[i]
        if s not in maps:
            maps[s] = _limits_map([(s, x["field"], x["unit"], x["size"]) for x in column[i].as_py() or []])
        return maps[s].get((s, f), _NONE)

    return of


def score_values(df: DataFrame, model: Model, limits: dict | DataFrame, keys: list[str], source: str, fields: list[str]) -> DataFrame:
    """``keys, source, field, score, cut``: one row per non-null value; a value in which nothing is said scores null and is not cut."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, source]) + ", field string, score double, cut boolean"
    rows, known = with_limits(df.select(*keys, source, *fields), limits, keys, source)
    shared = df.sparkSession.sparkContext.broadcast((model, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lim = shared.value
        for b in batches:
            of = limits_of(b, source, lim)
            for f in fields:
                at, scores = [], []
                for i, text in enumerate(b.column(f).to_pylist()):
                    if text is None:
                        continue
                    x = features(text, of(i, f), m.words)
                    at.append(i)
                    scores.append(None if x is None else float(m.weights[x].sum()) - m.threshold)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(k).take(take) for k in [*keys, source]] + [pa.array([f] * len(at), pa.string()), pa.array(scores, pa.float64()), pa.array([s is not None and s > 0 for s in scores], pa.bool_())],
                    [*keys, source, "field", "score", "cut"],
                )

    return rows.mapInArrow(run, schema)


def cut_rates(scored: DataFrame, source: str) -> DataFrame:
    """``source, field, n_values, n_cut, cut_rate``."""
    out = scored.groupBy(source, "field").agg(F.count(F.lit(1)).alias("n_values"), F.count_if("cut").alias("n_cut"))
    return out.withColumn("cut_rate", F.col("n_cut") / F.col("n_values"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    model, limits = fit_model(spark, d)
    segments = delivered_once(table(spark, d, "segments", "run_id", "idx", "feed", *FIELDS, "loaded_at"), "run_id", "idx")
    return score_values(segments, model, limits, ["run_id", "idx"], "feed", FIELDS)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("cut").select("run_id", "idx", "field")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return cut_rates(_scored(spark, d), "feed")


QUERIES = {"p6_found": p6_found, "p6_rates": p6_rates}
ORACLES: dict[str, str] = {}
