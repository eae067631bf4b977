"""Transcripts into clean, ordered speaker turns (problem 2).

The tokens of a segment are tagged speaker, timestamp, annotation, filler or speech by a hidden
Markov model over token shapes, filler phrases and what sets them off. Which shapes a state can emit
is given; steps between states and emissions are estimated on a bounded sample by Viterbi training,
and every text is decoded by Viterbi, so whether `este` is a filler, what a dash belongs to or which
part a loose mark goes with depends on the tokens around it. The speech tokens are
the clean text; a segment without any is left out. Labels spelt in many ways are joined to the
cast by their aliases; segments without a label take the label in their text, else the speaker of
their words; consecutive segments of one speaker form a turn.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import delivered_once, finite, table
from . import marks as M
from .sentence_ops import bounded_sample
from .sentences import _guess

STATES = ["speaker", "timestamp", "annotation", "filler", "speech"]
SAMPLE_TEXTS = 3_000
#: Segments and words are laid into time buckets of this length to be joined and ordered in pieces.
BUCKET_S = 20.0
BLOCK_S = 900.0
SLACK_S = 0.001
#: Seconds in which a character is spoken, where a segment has no end.
READ_S = 0.06

_FILLER_PHRASES = sorted({f for fs in M.FILLERS.values() for f in fs}, key=lambda f: (-len(f), f))
_DENSE = "฀-๿぀-ヿ㐀-鿿"
_dense_fillers = "|".join(re.escape(f) for f in _FILLER_PHRASES if re.search(f"[{_DENSE}]", f))
_spaced_fillers = "|".join(re.escape(f).replace(r"\ ", r"\s+") for f in _FILLER_PHRASES if not re.search(f"[{_DENSE}]", f))
_TOKEN = re.compile(
    rf"""(?P<clock>[\[(<]?(?<![\d:.])(?:\d{{1,2}}:)?\d{{1,2}}:\d{{2}}(?:[.,]\d{{1,3}})?(?![\d:])[\])>]?)
    |(?P<tag>\[[A-Z]\]|<[A-ZÀ-Þ][\w'’-]*(?:\ [A-ZÀ-Þ][\w'’-]*)?>)
    |(?P<note>\[[^\[\]\n]{{0,40}}\]|【[^】\n]{{0,40}}】|\{{[^{{}}\n]{{0,40}}\}}|<[^<>\n]{{1,40}}>|\*[^*\n]{{1,40}}\*|♪[^♪\n]{{0,40}}♪|[♪♫]+|＜[^＜＞\n]{{1,40}}＞|［[^［］\n]{{0,40}}］|〔[^〔〕\n]{{0,40}}〕|\([^()\n]{{1,40}}\)|（[^（）\n]{{1,40}}）)
    |(?P<label>(?:>>\s*|[-–—]\s*)?(?:(?:[Ss]peaker|SPEAKER|Spkr\.?)[\ _-]?[A-Z0-9]{{1,2}}|[A-ZÀ-Þ][\w'’-]*(?:\ [A-ZÀ-Þ][\w'’-]*){{0,2}})\s?:(?=\s|$))
    |(?P<dash>>>|(?<!\S)[-–—](?=\s))
    |(?P<filler>(?<![^\W_])(?:{_spaced_fillers})(?![^\W_'’-])|(?:{_dense_fillers}))
    |(?P<dense>[{_DENSE}](?:[{_DENSE}]*?(?=(?:[、，。…！？；：\s]|[^{_DENSE}]|$))))
    |(?P<word>[^\s{_DENSE}\[【{{<♪＜［〔(（]+)
    |(?P<other>[^\s])""",
    re.X | re.I,
)
_PHRASES = frozenset(_FILLER_PHRASES)
# Fillers that are ordinary words as well.
_WORD_LIKE = frozenset("este pues em à ừ er ah ben hm".split())
# `I` must not loosen the case of names: labels are checked again below.
_CASED_LABEL = re.compile(r"(?:>>\s*|[-–—]\s*)?(?:(?:[Ss]peaker|SPEAKER|Spkr\.?)[ _-]?[A-Z0-9]{1,2}|[A-ZÀ-Þ][\w'’-]*(?: [A-ZÀ-Þ][\w'’-]*){0,2})\s?:")

#: What each state can emit. Only this is given; how likely is estimated.
CAN = {
    "speaker": ["tag", "label0", "label", "dash"], "timestamp": ["clock", "dash", "mark"], "annotation": ["note", "tag"], "filler": ["filler", "mark"],
    "speech": ["word", "dense", "number", "paren", "label0", "label", "filler", "mark", "dash"],
}
#: Shapes that a single state emits.
ONLY = {k: next(s for s in STATES if k in CAN[s]) for k in {k for e in CAN.values() for k in e} if sum(k in e for e in CAN.values()) == 1}
OUTSIDE = "^"  # before the first token and after the last
#: Whether a text holds anything but plain speech.
_SPECIAL = re.compile(rf"[\[\](){{}}<>*♪♫【（＜［〔]|\d:\d|^\s*\S+(?: \S+){{0,2}}\s?:|(?<!\S)[-–—](?=\s)|(?<![^\W_])(?:{_spaced_fillers})(?![^\W_'’-])|{_dense_fillers}", re.I)


def shapes(text: str) -> list[tuple[str, int, int]]:
    """(shape, start, end) of the tokens of a text; which of its states a shape stands for is left to the model."""
    out: list[tuple[str, int, int]] = []
    at, n = 0, len(text)
    opened = True  # nothing said yet: a label may stand here
    clause = True
    while at < n:
        m = _TOKEN.match(text, at)
        if m is None:
            at += 1
            continue
        kind, a, b = m.lastgroup, m.start(), m.end()
        s = m.group()
        if kind == "label":
            if not _CASED_LABEL.fullmatch(s):
                kind = "word"
                b = a + len(s.split()[0])
                s = text[a:b]
            else:
                kind = "label0" if opened else "label"
        elif kind == "tag" and not (s[1:2].isupper()):
            kind = "note"
        elif kind == "note" and s[0] in "(（" and (a and not text[a - 1].isspace() or s.count(" ") > 2):
            kind = "paren"
        elif kind == "filler" and re.match(f"[{_DENSE}]", s) and not clause:
            m2 = re.compile(f"[{_DENSE}]+").match(text, a)
            kind, b = "dense", m2.end() if m2 else b
            s = text[a:b]
        elif kind == "word":
            core = s.strip("\"'“”‘’«»„.,;:!?…¿¡、，。！？；：")
            kind = "mark" if not any(c.isalnum() for c in s) else "number" if core[:1].isdigit() else "word"
        elif kind == "other":
            kind = "mark"
        out.append((kind, a, b))
        if kind in ("word", "dense", "number", "paren"):
            opened = False
        clause = kind not in ("dense",) or s[-1:] in "、，。…！？；： "
        at = b
    _join_fillers(text, out)
    return out


def _join_fillers(text: str, out: list[tuple[str, int, int]]) -> None:
    """Fillers of two words that a note stands between."""
    spoken = [k for k, t in enumerate(out) if t[0] not in ("note", "clock", "tag")]
    word = lambda k: text[out[k][1] : out[k][2]].strip(",.;:!?…").lower()
    for k, nxt in zip(spoken, spoken[1:]):
        if nxt > k + 1 and out[k][0] == out[nxt][0] == "word" and f"{word(k)} {word(nxt)}" in _PHRASES:
            out[k], out[nxt] = ("filler", *out[k][1:]), ("filler", *out[nxt][1:])


#: What is seen of a token besides its shape.
SLOTS = {"filler": ("phrase", "before", "after"), "mark": ("tied",)}


def observed(text: str, tokens: list[tuple[str, int, int]]) -> list[tuple[str, ...]]:
    """What the model sees of each token: its shape, then the values of its SLOTS.

    Of a filler that is the phrase in its language (guessed by the text, as `um` is a word in one
    and a filler in another) and, in a text with marks, what sets it off on either side; of a loose
    mark whether it is tied to the token before it.
    """
    marked = any(c in text for c in ",，、.。!?！？…")
    lang = _guess(text) if any(t[0] == "filler" for t in tokens) else ""
    out: list[tuple[str, ...]] = []
    for k, (kind, a, b) in enumerate(tokens):
        if kind == "filler":
            o = ("filler", lang + " " + " ".join(text[a:b].lower().split()))
            if marked:
                before = "edge" if k == 0 or tokens[k - 1][0] not in ("word", "dense", "number") else "mark" if text[tokens[k - 1][2] - 1] in _SET_OFF else "plain"
                after = "edge" if b == len(text) or k + 1 < len(tokens) and tokens[k + 1][0] not in ("word", "dense", "number", "mark") else "mark" if text[b] in _SET_OFF else "plain"
                o = (*o, before, after)
            out.append(o)
        elif kind == "mark":
            out.append(("mark", "tied" if k and tokens[k - 1][2] == a else "free"))
        else:
            out.append((kind,))
    return out


_SET_OFF = ",.;:!?…—-，、。！？；："


def seeded(seen: list[tuple[str, ...]]) -> list[str | None]:
    """The states that can be told without a model, from which it is first estimated; None where only the sequence can tell."""
    out: list[str | None] = []
    for k, o in enumerate(seen):
        kind = o[0]
        last = out[-1] if out else None
        nxt = seen[k + 1][0] if k + 1 < len(seen) else OUTSIDE
        if kind in ONLY:
            out.append(ONLY[kind])
        elif kind == "filler":
            lone = len(o) > 2 and "plain" not in o[2:]
            plain = len(o) > 2 and o[2:] == ("plain", "plain")
            lang, phrase = o[1].split(" ", 1)
            word_like = phrase in _WORD_LIKE or phrase not in M.FILLERS.get(lang, ())
            out.append("filler" if lone or not word_like else "speech" if plain else None)
        elif kind == "mark":
            out.append(last if o[1] == "tied" and last in ("filler", "timestamp") else "speech")
        elif kind == "dash":
            out.append("timestamp" if last == "timestamp" else "speaker" if nxt in ("label0", "tag") or not k else "speech" if last == "speech" else None)
        elif kind == "label0":
            out.append("speaker")
        elif kind == "label":
            out.append("speech")
        else:  # a tag
            out.append("speaker" if k == 0 else None)
    return out


class Tagger:
    """A hidden Markov model: log-probabilities of steps between states and of what a state emits.

    What is seen of a token (:func:`observed`) is independent given its state. All of it are relative
    frequencies with half a count added.
    """

    def __init__(self, steps: Counter, emitted: Counter):
        self.step: dict[tuple[str, str], float] = {}
        for a in (OUTSIDE, *STATES):
            total = sum(steps[a, b] for b in (*STATES, OUTSIDE)) + 0.5 * (len(STATES) + 1)
            for b in (*STATES, OUTSIDE):
                self.step[a, b] = math.log((steps[a, b] + 0.5) / total)
        self.seen: dict[tuple, float] = {}
        self.unseen: dict[tuple, float] = {}
        values: dict[str, set[str]] = {}
        for _, slot, v in emitted:
            values.setdefault(slot, set()).add(v)
        for s in STATES:
            for slot in ("shape", *(x for xs in SLOTS.values() for x in xs)):
                known = CAN[s] if slot == "shape" else sorted(values.get(slot, ()))
                total = sum(emitted[s, slot, v] for v in known) + 0.5 * (len(known) + 1)
                self.unseen[s, slot] = math.log(0.5 / total)
                for v in known:
                    self.seen[s, slot, v] = math.log((emitted[s, slot, v] + 0.5) / total)

    def emission(self, state: str, o: tuple[str, ...]) -> float:
        if o[0] not in CAN[state]:
            return float("-inf")
        score = self.seen[state, "shape", o[0]]
        for slot, v in zip(SLOTS.get(o[0], ()), o[1:]):
            score += self.seen.get((state, slot, v), self.unseen[state, slot])
        return score

    def apart(self, o: tuple[str, ...]) -> str:
        """The state that most likely emits a token seen by itself; what the sequence is worth is measured against it."""
        return max(STATES, key=lambda s: self.emission(s, o))

    def tag(self, text: str) -> list[tuple[str, int, int]]:
        """(state, start, end) of every token: the best path by Viterbi.

        A shape that only one state can emit fixes its state, so the lattice is decoded in the
        stretches between such tokens, which gives the same path as decoding all of it.
        """
        tokens = shapes(text)
        seen = observed(text, tokens)
        path: list[str] = []
        i, n = 0, len(tokens)
        while i < n:
            only = ONLY.get(tokens[i][0])
            if only:
                path.append(only)
                i += 1
                continue
            j = i
            while j < n and tokens[j][0] not in ONLY:
                j += 1
            path += self._decode(seen[i:j], path[-1] if path else OUTSIDE, ONLY[tokens[j][0]] if j < n else OUTSIDE)
            i = j
        return [(s, a, b) for s, (_, a, b) in zip(path, tokens)]

    def _decode(self, seen: list[tuple[str, ...]], before: str, after: str) -> list[str]:
        score = {s: self.step[before, s] + self.emission(s, seen[0]) for s in STATES}
        back: list[dict[str, str]] = []
        for o in seen[1:]:
            now, arg = {}, {}
            for s in STATES:
                p = max(STATES, key=lambda q: score[q] + self.step[q, s])
                now[s] = score[p] + self.step[p, s] + self.emission(s, o)
                arg[s] = p
            score = now
            back.append(arg)
        s = max(STATES, key=lambda q: score[q] + self.step[q, after])
        path = [s]
        for arg in reversed(back):
            s = arg[s]
            path.append(s)
        return path[::-1]


def fit(texts: list[str], rounds: int = 3) -> Tagger:
    """Steps and emissions by Viterbi training.

    First from the tokens whose state is plain by itself, then from the best paths of the model
    before; deterministic in the multiset of texts.
    """
    plain = [M.unescape(t)[0] for t in texts]
    kept = [(t, observed(t, shapes(t))) for t in plain]
    paths = [seeded(o) for _, o in kept]
    model = _estimate(kept, paths)
    for _ in range(rounds):
        model = _estimate(kept, [[s for s, _, _ in model.tag(t)] for t, _ in kept])
    return model


def _estimate(kept: list[tuple[str, list[tuple[str, ...]]]], paths: list[list[str | None]]) -> Tagger:
    steps, emitted = Counter(), Counter()
    for (_, seen), path in zip(kept, paths):
        if not path:
            continue
        whole = [OUTSIDE, *path, OUTSIDE]
        steps.update((a, b) for a, b in zip(whole, whole[1:]) if a and b)
        emitted.update((s, slot, v) for s, o in zip(path, seen) if s for slot, v in zip(("shape", *SLOTS.get(o[0], ())), o))
    return Tagger(steps, emitted)


def clean(text: str | None, model: Tagger) -> tuple[str, str | None]:
    """(clean speech, speaker label in the text). Empty speech means that nothing is said."""
    if not text:
        return "", None
    plain = M.unescape(text)[0]
    if not _SPECIAL.search(plain):
        said = " ".join(plain.split())
        return (said if any(c.isalnum() for c in said) else ""), None
    tags = model.tag(plain)
    label = next((plain[a:b] for s, a, b in tags if s == "speaker" and any(c.isalnum() for c in plain[a:b])), None)
    parts: list[str] = []
    end = None
    for s, a, b in tags:
        if s == "speech":
            glued = end is None or a == end or not plain[end:a].strip() and not re.search(r"\s", plain[end:a])
            parts.append(("" if glued else " ") + plain[a:b])
            end = b
    said = re.sub(r"\s+([,.;:!?…、，。！？])", r"\1", "".join(parts))
    said = re.sub(r"^[\s,.;:!?…、，。！？-]+", "", re.sub(r"([,、，])[,、，\s]*(?=[,、，])", "", said)).strip()
    return (said if any(c.isalnum() for c in said) else ""), label


# -- DataFrame operators -------------------------------------------------------------------------------


def label_key(c: Column) -> Column:
    """One spelling for a speaker label: lower case, no brackets, marks, role or prefix, single spaces, first name first."""
    x = F.lower(F.regexp_replace(c, r"\([^)]*\)|[\[\]<>:]|^\s*(?:>>|[-–—])\s*", " "))
    x = F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"^(?:speaker|spkr\.?|spk)[ _.-]*([a-z0-9]{1,2})$", "$1")
    x = F.regexp_replace(x, r"^([^,]+),\s*(.+)$", "$2 $1")
    return F.when((x == "") | x.isin("unknown", "narrator", "none", "null", "n/a", "unk", "?"), None).otherwise(x)


def cast_aliases(cast: DataFrame) -> DataFrame:
    """``run_id, alias, letter``: the spellings that name exactly one speaker of a run."""
    name = F.lower(F.trim(F.regexp_replace("display_name", r"\s+", " ")))
    first, last = F.regexp_extract(name, r"^(\S+)", 1), F.regexp_extract(name, r"(\S+)$", 1)
    dot = lambda a, b: F.concat_ws(" ", a, b)
    initial = lambda w: F.concat(F.substring(w, 1, 1), F.lit("."))
    forms = F.array(F.lower("speaker"), name, first, last, dot(first, initial(last)), dot(initial(first), last), F.concat_ws(" ", last, first))
    rows = cast.where(F.col("run_id").isNotNull() & F.col("speaker").isNotNull()).select("run_id", F.col("speaker").alias("letter"), F.explode(F.array_distinct(forms)).alias("alias"))
    one = rows.where(F.col("alias").isNotNull() & (F.col("alias") != "")).groupBy("run_id", "alias").agg(F.min("letter").alias("letter"), F.max("letter").alias("_other"))
    return one.where(F.col("letter") == F.col("_other")).drop("_other")


def tag_segments(segments: DataFrame, model: Tagger, keep: list[str]) -> DataFrame:
    """Columns ``keep`` plus ``clean_text, text_label`` of the segments in which something is said in ``text_src``."""
    shared = segments.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in segments.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            at, said, labels = [], [], []
            for i, t in enumerate(b.column("text_src").to_pylist()):
                text, label = clean(t, m)
                if text:
                    at.append(i)
                    said.append(text)
                    labels.append(label)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(c).take(take) for c in keep] + [pa.array(said, pa.string()), pa.array(labels, pa.string())], [*keep, "clean_text", "text_label"])

    return segments.select(*keep, "text_src").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", clean_text string, text_label string")


def _by_words(unnamed: DataFrame, words: DataFrame) -> DataFrame:
    """``run_id, idx, by_words``: the speaker of the words in the span of a segment.

    Words that occur in the segment's own text count before others, since spans overlap; then the
    number of words decides, then the earliest word. Joined on the run and a time bucket. A word
    delivered twice counts once: only the words inside a span are reduced, by ``word_idx`` or, where
    the words have none, by their content.
    """
    bucket = lambda c: F.floor(c / BUCKET_S)
    # An open or reversed span is taken to last as long as its text is read.
    begun = unnamed.withColumn("start_s", finite(F.col("start_s"))).withColumn("end_s", finite(F.col("end_s"))).where(F.col("start_s").isNotNull())
    end = F.when(F.col("end_s") > F.col("start_s"), F.col("end_s")).otherwise(F.col("start_s") + 0.5 + READ_S * F.length("text_src"))
    # A word up to SLACK_S outside a span may lie in the next bucket: buckets of words are SLACK_S early, and a span reaches as far.
    reach = F.sequence(bucket(F.col("start_s")), bucket(F.col("end_s") + 2 * SLACK_S))
    spans = begun.withColumn("end_s", end).select("run_id", "idx", "start_s", "end_s", F.lower("text_src").alias("said"), F.explode(reach).alias("_bucket"))
    key = ["word_idx"] if "word_idx" in words.columns else []
    heard = words.where(F.col("speaker").isNotNull() & F.col("word").isNotNull()).select("run_id", F.col("start_s").alias("ws"), F.col("end_s").alias("we"), "word", F.col("speaker").alias("heard"), bucket(F.col("start_s") + SLACK_S).alias("_bucket"), *key)
    inside = (F.col("ws") >= F.col("start_s") - SLACK_S) & (F.col("we") <= F.col("end_s") + SLACK_S)
    core = F.lower(F.regexp_replace("word", r"^[\p{P}\s]+|[\p{P}\s]+$", ""))
    pairs = spans.join(heard, ["run_id", "_bucket"]).where(inside).select("run_id", "idx", "heard", "ws", "we", "word", F.contains("said", core).cast("int").alias("own"), *key)
    once = pairs.groupBy("run_id", "idx", *(key or ["heard", "ws", "we", "word"])).agg(F.min(F.struct("heard", "ws", "own")).alias("x")).select("run_id", "idx", "x.*")
    votes = once.groupBy("run_id", "idx", "heard").agg(F.sum("own").alias("own"), F.count(F.lit(1)).alias("n"), F.min("ws").alias("first"))
    best = F.max_by("heard", F.struct("own", "n", -F.col("first")))
    return votes.groupBy("run_id", "idx").agg(best.alias("by_words"))


def _closest_name(unknown: DataFrame, cast: DataFrame) -> DataFrame:
    """``run_id, key, closest``: the speaker whose name differs from a misspelt label by at most two letters in ten."""
    name = F.lower(F.trim(F.regexp_replace("display_name", r"\s+", " ")))
    pairs = unknown.select("run_id", "key").distinct().join(cast.select("run_id", F.col("speaker").alias("letter"), name.alias("name")), "run_id")
    far = F.levenshtein("key", "name")
    near = pairs.withColumn("far", far).where(F.col("far") <= F.greatest(F.lit(2), F.length("name") * 0.2))
    return near.groupBy("run_id", "key").agg(F.min_by("letter", F.struct("far", "letter")).alias("closest"))


def name_segments(segments: DataFrame, cast: DataFrame, words: DataFrame, model: Tagger) -> DataFrame:
    """``run_id, idx, start_s, end_s, clean_text, letter`` of the segments in which something is said.

    ``letter`` comes from the segment's label, else the label in its text, else its words; it is
    null where none of them tells. Labels and words are joined before the texts are tagged, so each
    text is tagged once.
    """
    aliases = cast_aliases(cast)
    alias = lambda key, out: aliases.select("run_id", F.col("alias").alias(key), F.col("letter").alias(out))
    keyed = segments.withColumn("key", label_key(F.col("speaker")))
    labels = keyed.where(F.col("key").isNotNull()).select("run_id", "key").distinct().join(alias("key", "by_alias"), ["run_id", "key"], "left")
    labels = labels.join(_closest_name(labels.where(F.col("by_alias").isNull()), cast), ["run_id", "key"], "left")
    named = keyed.join(labels.select("run_id", "key", F.coalesce("by_alias", "closest").alias("by_label")), ["run_id", "key"], "left")
    heard = _by_words(named.where(F.col("by_label").isNull()), words)
    voted = named.join(heard, ["run_id", "idx"], "left")
    said = tag_segments(voted, model, ["run_id", "idx", "start_s", "end_s", "by_label", "by_words"])
    said = said.withColumn("text_key", label_key(F.col("text_label"))).join(alias("text_key", "by_text"), ["run_id", "text_key"], "left")
    return said.select("run_id", "idx", "start_s", "end_s", "clean_text", F.coalesce("by_label", "by_text", "by_words").alias("letter"))


def _islands(df: DataFrame, keys: list[str], text_parts: Column) -> DataFrame:
    """Rows of equal ``letter`` that follow each other within ``keys`` in order of (start_s, first_idx), merged."""
    w = Window.partitionBy(*keys).orderBy("start_s", "first_idx")
    new = F.coalesce(F.col("letter") != F.lag("letter").over(w), F.lit(True)).cast("int")
    marked = df.withColumn("_new", new).withColumn("_turn", F.sum("_new").over(w))
    order = F.struct("start_s", "first_idx")
    return marked.groupBy(*keys, "_turn").agg(
        F.min_by("first_idx", order).alias("first_idx"), F.max_by("last_idx", order).alias("last_idx"), F.first("letter").alias("letter"),
        F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), text_parts.alias("parts"),
    ).drop("_turn")


def turns(said: DataFrame) -> DataFrame:
    """``run_id, first_idx, last_idx, speaker, start_s, end_s, text``: the turns of every run.

    Input as from :func:`name_segments`. Order is start_s, then idx; a segment without any speaker
    takes the one before it, those ahead of the first named segment of a run take its speaker. Segments
    without a start are left out. Turns are first built inside time blocks, so a very large run is
    spread over tasks, then joined where blocks meet; there the segments ahead of the first named one
    of a block get the last speaker of the blocks before.
    """
    rows = said.where(F.col("start_s").isNotNull() & ~F.isnan("start_s"))
    rows = rows.withColumn("_block", F.floor(F.col("start_s") / BLOCK_S))
    back = Window.partitionBy("run_id", "_block").orderBy("start_s", "idx")
    filled = rows.withColumn("letter", F.last("letter", True).over(back))
    part = F.struct("start_s", F.col("first_idx").alias("i"), F.col("clean_text").alias("t"))
    inside = _islands(filled.withColumn("first_idx", F.col("idx")).withColumn("last_idx", F.col("idx")), ["run_id", "_block"], F.array_sort(F.collect_list(part)))
    run = Window.partitionBy("run_id").orderBy("start_s", "first_idx")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = inside.withColumn("letter", F.coalesce(F.last("letter", True).over(run), F.first("letter", True).over(whole)))
    joined = _islands(carried, ["run_id"], F.array_sort(F.flatten(F.collect_list("parts"))))
    return joined.select("run_id", "first_idx", "last_idx", F.col("letter").alias("speaker"), "start_s", "end_s", F.concat_ws(" ", F.transform("parts", lambda p: p["t"])).alias("text"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    model = fit(bounded_sample(table(spark, d, "segments", "run_id", "idx", "text_src"), ["run_id", "idx"], "text_src", SAMPLE_TEXTS))
    segments = delivered_once(table(spark, d, "segments", "run_id", "idx", "start_s", "end_s", "speaker", "text_src", "loaded_at"), "run_id", "idx")
    cast = table(spark, d, "speakers", "run_id", "speaker", "display_name")
    words = table(spark, d, "words", "run_id", "word_idx", "start_s", "end_s", "word", "speaker")
    return turns(name_segments(segments, cast, words, model))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("run_id", "first_idx", "last_idx", "speaker")


def p2_turns(spark: SparkSession, d: str) -> DataFrame:
    """The turns with their clean text."""
    return _turns(spark, d)


QUERIES = {"p2_found": p2_found, "p2_turns": p2_turns}
ORACLES: dict[str, str] = {}
