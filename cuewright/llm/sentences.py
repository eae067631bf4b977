"""Sentence boundaries across languages and scripts (problem 1): model and decoding.

A text is a sequence of candidate cuts. A logistic model gives each candidate the log-odds of being
a boundary from the words that close the left side, the words that open the right side, the mark
between them and (for a word stream) the pause. A semi-Markov dynamic program then selects whole
spans: the score of a span joins its closing and opening log-odds, the density of its length and a
penalty for quotations left open.

The model is fitted at plan time on a bounded sample of short units that are known to begin and end
with a sentence (subtitle cues): the seam between two units is a positive, every place inside a unit
a negative. It is trained twice, on the units as written and on the units stripped of case and
punctuation, so that unpunctuated texts are segmented by their words alone.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field

import numpy as np

from . import marks as M

#: Bounds of the labelled sample.
SAMPLE_UNITS = 5_000
SAMPLE_TEXTS = 3_000
#: Log-odds for the pause after a word, by its length in seconds: below the first bound the first
#: value, and so on.
PAUSE_BOUNDS = (0.1, 0.25, 0.55, 0.9)
PAUSE_MARKED = (-2.0, 0.4, 0.7, 1.0, 1.2)
PAUSE_BARE = (-3.0, -1.5, -0.7, 6.0, 7.0)
#: Pause after fillers alone from which they are an utterance of their own, not the opening of the
#: next sentence, for streams with marks (where the next word must be no lower-case one) and without.
FILLER_PAUSE = (0.1, 0.55)
#: Log-odds for an end mark that was left in a text without marks.
STRAY_MARK = 2.0
#: Log-odds of a cut after fillers that an end mark closes.
FILLER_SCORE = 4.0
QUOTE_PENALTY = 4.0
#: Weight and bound of the length density, for texts with marks and without.
LENGTH_WEIGHT = {False: (0.1, 0.8), True: (0.2, 2.0)}
#: Candidates below this log-odds are not tried: a cut loses more by them than the length density
#: (LENGTH_WEIGHT, at most 2) could win back by two spans in place of one.
FLOOR = -5.0
#: A stream with marks after at most this share of its words is taken to be written without them.
BARE_SHARE = 0.04

_END = re.escape(M.ENDERS)
# A mark that may end a sentence with what closes it; the mark of a decimal or a file name has a letter or digit after it.
_MARK = re.compile(rf"[{_END}]+(?:[   ]?[»]|[\"'”’)\]」』】））〉》])*")
_COMMA = re.compile(r"[,;:](?=\s|$)|[、，；：]")
_TOKEN = re.compile(r"\S+")
_DIGITS = re.compile(r"\d+")
_STRIP = ".!?…。！？｡,;:、，；：\"'“”‘’«»„「」『』()（）[]【】{}<>¿¡-–—*♪ "
_LATIN = re.compile(r"[^\W\d_฀-๿぀-ヿ㐀-鿿]+")
_PUNCT = re.compile(r"[\s" + re.escape(_STRIP) + "]+")
_FILLER_WORDS = {w for ws in M.FILLERS.values() for f in ws for w in f.split()}


@dataclass
class Model:
    """Weights by feature; ``common`` is the vocabulary, other words count as one rare word."""

    weights: dict[str, float]
    common: frozenset[str]
    #: Mean and spread of log length, in tokens (spaced) or characters (unspaced).
    length: dict[str, tuple[float, float]]
    memo: dict = field(default_factory=dict)

    def __getstate__(self):
        return (self.weights, self.common, self.length)

    def __setstate__(self, s):
        self.weights, self.common, self.length = s
        self.memo = {}


def norm(token: str) -> str:
    """A word for comparison: lower case, outer punctuation off, digits as one sign."""
    t = token.strip(_STRIP).lower()
    return t if t.isalpha() else _DIGITS.sub("#", t)


# -- features ------------------------------------------------------------------------------------


def _kind(c: str) -> str:
    if not c:
        return "end"
    if c.isdigit():
        return "9"
    if c in "\"'“«„「『¿¡‘":
        return "q"
    if c.isalpha():
        return "a" if c.islower() else "A" if c.isupper() else "z"
    return "-"


def _word_features(style: str, left: tuple, right: tuple) -> list[str]:
    """Context of a cut between words; ``left`` ends and ``right`` starts at the cut, three words each."""
    l3, l2, l1 = left
    r1, r2, r3 = right
    return [
        style + "b",
        style + "l" + l1,
        style + "m" + l2 + " " + l1,
        style + "n" + l3 + " " + l2 + " " + l1,
        style + "r" + r1,
        style + "s" + r1 + " " + r2,
        style + "t" + r1 + " " + r2 + " " + r3,
        style + "x" + l1 + "|" + r1,
    ]


def _char_features(style: str, left: str, right: str) -> list[str]:
    f = [style + "B", style + "X" + left[-1:] + "|" + right[:1], style + "Y" + left[-2:] + "|" + right[:2]]
    f += [style + "L" + left[-k:] for k in (1, 2, 3, 4, 6)]
    f += [style + "R" + right[:k] for k in (1, 2, 3, 4, 6, 8)]
    return f


def _mark_features(mark: str, gap: str, nxt: str, before_quote: str, abbreviated: str, l1: str) -> list[str]:
    """``mark`` is the run of marks and closers, ``gap`` the space after it, ``nxt`` the next character."""
    k, core = _kind(nxt), mark[0] if len(mark) == 1 or mark[1] not in M.ENDERS else mark[:2]
    closed = "c" if any(c in M.CLOSERS for c in mark) else ""
    g = "" if not gap else "n" if "\n" in gap else "s"
    return [
        "Mk" + core + closed + g + k,
        "Mq" + closed + before_quote + k,
        "Ma" + abbreviated + k,
        "Mw" + l1 + k,
        "Ml" + l1 + core,
    ]


def _space_features(text: str, at: int) -> list[str]:
    """A space in an unspaced script: the sign before it and the kind of the character after it."""
    before = text[at - 1]
    after = text[at:].lstrip()[:1]
    sign = before if before in _STRIP else "0" if before.isdigit() else "N" if before < "฀" else "z"
    return ["Vs" + sign + _kind(after), "Vt" + sign + text[max(0, at - 4) : at], "Vu" + text[max(0, at - 4) : at]]


def _compact(text: str) -> tuple[str, list[int]]:
    """Unspaced text reduced to its letters: names as N, numbers as 0; with the end of each in ``text``."""
    out: list[str] = []
    ends: list[int] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c in _STRIP or c.isspace():
            i += 1
        elif c.isdigit():
            while i < n and (text[i].isdigit() or text[i] in ".,:" and i + 1 < n and text[i + 1].isdigit()):
                i += 1
            out.append("0")
            ends.append(i)
        elif c < "฀" and c.isalpha():
            i += 1
            while i < n and text[i] < "฀" and (text[i].isalnum() or text[i] in "-.'’" and i + 1 < n and text[i + 1].isalnum() and text[i + 1] < "฀"):
                i += 1
            out.append("N")
            ends.append(i)
        else:
            i += 1
            out.append(c)
            ends.append(i)
    return "".join(out), ends


def _quote_context(text: str, at: int) -> str:
    """What stands before the quotation that is closed just before ``at``: s(tart), c(olon or comma), o(ther), or nothing."""
    for back in range(at - 1, max(-1, at - 4), -1):
        c = text[back]
        for o, e in (*M.QUOTE_PAIRS.items(), ('"', '"')):
            if c == e:
                start = text.rfind(o, 0, back)
                if start < 0:
                    return ""
                before = text[:start].rstrip()
                if not before:
                    return "s"
                return "c" if before[-1] in ":：,，" else "s" if before[-1] in M.ENDERS + M.CLOSERS else "o"
    return ""


# -- candidates ----------------------------------------------------------------------------------


@dataclass
class Text:
    """A text with its candidate cuts: end (characters up to the cut), token count so far, score."""

    ends: list[int]
    sizes: list[int]
    scores: list[float]
    total: int
    unspaced: bool


def bare(text: str) -> bool:
    """Whether the text is written without case and marks.

    A stray mark does not matter, as some survive where marks were taken out; a text with a capital
    or with marks as often as prose has them is not bare.
    """
    if any(map(str.isupper, text)):
        return False
    few = max(1, len(text.split()) // 8)
    found = len(_COMMA.findall(text))
    if found > few:
        return False
    for m in _MARK.finditer(text):
        e = m.end()
        if text[m.start()] in "。！？":
            return False
        found += e == len(text) or text[e].isspace()
    return found <= few and (found == 0 or text.isascii() or not M.is_unspaced(text))


def _triple(words: list[str], i: int, common: frozenset) -> tuple:
    """Words i-3, i-2, i-1 (``i`` may also count from the right side)."""
    return tuple(("" if j < 0 or j >= len(words) else words[j] if words[j] in common else "<r>" if words[j] else "<p>") for j in (i - 3, i - 2, i - 1))


def _score(model: Model, features: list[str]) -> float:
    w = model.weights
    return sum(w.get(f, 0.0) for f in features)


def _context_score(model: Model, style: str, key: tuple, unspaced: bool) -> float:
    memo_key = (style, key)
    s = model.memo.get(memo_key)
    if s is None:
        if len(model.memo) > 300_000:
            model.memo.clear()
        s = model.memo[memo_key] = _score(model, (_char_features if unspaced else _word_features)(style, *key))
    return s


def _abbreviation(token: str) -> str:
    t = token.strip("\"'“”‘’«»„()[]")
    if "." in t[:-1] and any(c.isalpha() for c in t):
        return "d"
    core = t.rstrip(".…!?")
    return "1" if len(core) == 1 and core.isalpha() else "U" if core[:1].isupper() and len(core) < 5 else ""


def marked_words(tokens: list[str], common: frozenset) -> list[tuple[int, tuple, list[str]]]:
    """Places after a closing mark: number of words before the cut, context key, mark features."""
    n = len(tokens)
    enders, closers = M.ENDERS, M.CLOSERS + "“"
    lower: dict[int, str] = {}

    def w(j: int) -> str:
        if j < 0 or j >= n:
            return ""
        v = lower.get(j)
        if v is None:
            v = norm(tokens[j])
            v = lower[j] = v if v in common else "<r>" if v else "<p>"
        return v

    out = []
    for i, t in enumerate(tokens):
        c = t[-1]
        if c not in enders:
            if c not in closers:
                continue
            core = t.rstrip(closers)
            # The mark may stand alone before a closing quote, as in French.
            if not ((core and core[-1] in enders) or (not core and i and tokens[i - 1][-1] in enders)):
                continue
        if i + 1 >= n:
            continue
        nxt = tokens[i + 1]
        if nxt[0] in enders + "»”’)" and not nxt.strip(_STRIP):  # the mark goes on
            continue
        j = i
        while j > 0 and not tokens[j].strip(_STRIP):
            j -= 1
        k = i + 1
        while k < n - 1 and not tokens[k].strip(_STRIP):
            k += 1
        key = ((w(j - 2), w(j - 1), w(j)), (w(k), w(k + 1), w(k + 2)))
        tail = tokens[j].rstrip(closers)
        mark = tail[len(tail.rstrip(enders)) :] + tokens[j][len(tail) :] + "".join(tokens[j + 1 : i + 1])
        quote = ""
        if any(c in closers for c in mark):
            near = " ".join(tokens[max(0, i - 60) : i + 1])
            quote = _quote_context(near, len(near))
        out.append((i + 1, key, _mark_features(mark or ".", " ", nxt[0], quote, _abbreviation(tokens[j]), key[0][2])))
    return out


def word_candidates(tokens: list[str], model: Model, is_bare: bool, pauses: list[float] | None = None) -> tuple[list[int], list[float]]:
    """Cuts of a list of words: number of words before each cut, and its score."""
    where: list[int] = []
    scores: list[float] = []
    if not is_bare:
        for i, key, extra in marked_words(tokens, model.common):
            s = _context_score(model, "p", key, False) + _score(model, extra)
            where.append(i)
            scores.append(s if pauses is None else s + _pause(pauses[i - 1], PAUSE_MARKED))
        return where, scores
    words = [norm(t) for t in tokens]
    for i in range(1, len(words)):
        s = _context_score(model, "u", (_triple(words, i, model.common), _triple(words, i + 3, model.common)), False)
        if pauses is not None:
            s += _pause(pauses[i - 1], PAUSE_BARE)
        if tokens[i - 1][-1] in M.ENDERS and not _abbreviation(tokens[i - 1]):
            s += STRAY_MARK
        if s > FLOOR:
            where.append(i)
            scores.append(s)
    return where, scores


def _skip_marks(text: str, at: int) -> int:
    """The end of the marks and closers that follow ``at`` directly."""
    while at < len(text) and text[at] in _STRIP and not text[at].isspace() and text[at] not in "“«„「『‘(（[【<*♪":
        at += 1
    return at


def _context(letters: str, i: int) -> tuple[str, str]:
    return letters[max(0, i - 6) : i], letters[i : i + 8]


def marked_chars(text: str, letters: str, ends: list[int]) -> list[tuple[int, int, tuple, list[str]]]:
    """Places after a closing mark of an unspaced text: end offset, letters before, context key, mark features."""
    out = []
    k, n = 0, len(letters)
    for m in _MARK.finditer(text):
        e = m.end()
        if e >= len(text):
            break
        while k < n and ends[k] <= m.start():
            k += 1
        if k == 0 or k == n:
            continue
        if m.group()[0] == "." and not text[e].isspace():
            continue
        after = e
        while after < len(text) and text[after].isspace():
            after += 1
        quote = _quote_context(text, e) if any(c in M.CLOSERS for c in m.group()) else ""
        out.append((e, k, _context(letters, k), _mark_features(m.group(), text[e:after], text[after : after + 1], quote, "", letters[k - 1])))
    return out


def char_candidates(text: str, model: Model, is_bare: bool, at: list[int] | None = None, pauses: list[float] | None = None, spaced: bool = False) -> tuple[list[int], list[float], list[int]]:
    """Cuts of an unspaced text: end offsets, scores, and the number of letters up to each.

    ``at`` limits the cuts to these offsets (word ends of a stream); ``spaced`` limits cuts without
    a mark to spaces, as scripts like Thai put them between sentences.
    """
    letters, ends = _compact(text)
    where: list[int] = []
    scores: list[float] = []
    sizes: list[int] = []
    allowed = None if at is None else {e: k for k, e in enumerate(at)}
    if is_bare:
        for i in range(1, len(letters)):
            e = ends[i - 1]
            stop = _skip_marks(text, e)
            if allowed is not None:
                stop = stop if stop in allowed else e
                if stop not in allowed:
                    continue
            elif spaced and not (stop < len(text) and text[stop].isspace()):
                continue
            s = _context_score(model, "v" if spaced else "u", _context(letters, i), True)
            if spaced:
                s += _score(model, _space_features(text, stop))
            if pauses is not None:
                s += _pause(pauses[allowed[stop]], PAUSE_BARE)
            if s > FLOOR:
                where.append(stop)
                scores.append(s)
                sizes.append(i)
        return where, scores, sizes
    for e, k, key, extra in marked_chars(text, letters, ends):
        s = _context_score(model, "p", key, True) + _score(model, extra)
        if allowed is not None:
            if e not in allowed:  # a mark inside a piece: the piece is the last of the sentence
                e = at[bisect_left(at, e)]
                if e == at[-1]:
                    continue
            s += _pause(pauses[allowed[e]], PAUSE_MARKED)
        where.append(e)
        scores.append(s)
        sizes.append(k)
    return where, scores, sizes


def _pause(seconds: float, table: tuple) -> float:
    if seconds != seconds:
        return 0.0
    for bound, value in zip(PAUSE_BOUNDS, table):
        if seconds < bound:
            return value
    return table[-1]


# -- semi-Markov decoding --------------------------------------------------------------------------


def _open_quotes(text: str) -> int:
    """Quotations left open or closed without an opening."""
    loose = text.count('"') % 2
    low = text.count("„")
    high, closing = text.count("“"), text.count("”")
    # „ … “ closes with the sign that opens “ … ”.
    loose += abs(low - high - closing) if low else abs(high - closing)
    for o, e in (("«", "»"), ("「", "」"), ("『", "』")):
        loose += abs(text.count(o) - text.count(e))
    return loose


def decode(sizes: list[int], scores: list[float], total: int, length: tuple[float, float], is_bare: bool, span_text) -> list[int]:
    """Indices of the chosen cuts. ``span_text(a, b)`` gives the text from cut a to cut b (-1 start, n end).

    best[j] = max over i < j of best[i] + score(j) + length(i, j) - quotes(i, j), where a cut that is
    not chosen scores nothing. Spans may be of any length. The length density is bounded, so once a
    span is long enough for its bound, no earlier start can be better than the best one before it
    less that bound; the search for a start ends where this falls short of what was found.
    """
    n = len(sizes)
    if n == 0:
        return []
    mean, spread = length
    weight, most = LENGTH_WEIGHT[is_bare]
    at = [0, *sizes, total]
    gain = [0.0, *scores, 0.0]
    best = [0.0] * (n + 2)
    ahead = [0.0] * (n + 2)  # the best of best[0..i], and where it is
    lead = [0] * (n + 2)
    back = [0] * (n + 2)
    log = math.log
    # From this size on the density is at its bound.
    long = math.exp(mean + spread * math.sqrt(2 * most / weight))
    quotes: dict[tuple[int, int], float] = {}

    def loose(i: int, j: int) -> float:
        q = quotes.get((i, j))
        if q is None:
            q = quotes[(i, j)] = QUOTE_PENALTY * min(_open_quotes(span_text(i - 1, j - 1)), 2)
        return q

    for j in range(1, n + 2):
        top, arg = -1e18, j - 1
        for i in range(j - 1, -1, -1):
            size = at[j] - at[i]
            if size > long:
                if ahead[i] - most <= top:
                    break
                if loose(lead[i], j) == 0:
                    top, arg = ahead[i] - most, lead[i]
                    break
                s = best[i] - most
            else:
                z = (log(size if size > 0 else 0.5) - mean) / spread
                s = best[i] - min(weight * z * z / 2, most)
            if s > top:
                s -= loose(i, j)
                if s > top:
                    top, arg = s, i
        best[j] = top + gain[j]
        ahead[j], lead[j] = (best[j], j) if best[j] > ahead[j - 1] else (ahead[j - 1], lead[j - 1])
        back[j] = arg
    chosen = []
    j = back[n + 1]
    while j > 0:
        chosen.append(j - 1)
        j = back[j]
    return chosen[::-1]


# -- texts and streams -------------------------------------------------------------------------------


def _only_fillers(words: list[str]) -> bool:
    seen = False
    for x in words:
        w = norm(x)
        if w and w not in _FILLER_WORDS:
            return False
        seen = seen or bool(w)
    return seen


def _fillers_only_text(text: str) -> bool:
    t = _PUNCT.sub("", text)
    while t:
        f = next((f for lang in ("zh", "ja", "th") for f in M.FILLERS[lang] if t.startswith(f)), None)
        if f is None:
            return False
        t = t[len(f) :]
    return True


def _settle_fillers(where: list[int], scores: list[float], sizes: list[int], only, ellipsis, apart) -> None:
    """Cuts right after nothing but fillers.

    After an ellipsis the fillers open the next sentence and the cut goes, unless ``apart`` tells
    that they stand alone; after an end mark they are an utterance of their own.
    """
    keep = []
    prev = 0
    for k, e in enumerate(where):
        if only(prev, e):
            if ellipsis(e) and not apart(e):
                continue
            scores[k] = max(scores[k], FILLER_SCORE)
        keep.append(k)
        prev = e
    for x in (where, scores, sizes):
        x[:] = [x[k] for k in keep]


def sentence_ends(text: str, model: Model) -> list[int]:
    """End offsets (code points of ``text`` as stored) of the sentences that are followed by another one."""
    if not text:
        return []
    plain, ends_of = M.unescape(text)
    said = M.speech(plain)
    if not said.strip(_STRIP):
        return []
    if M.is_unspaced(said):
        thai = M.SPACED_SENTENCES.search(said) is not None
        is_bare = thai or bare(said)
        where, scores, sizes = char_candidates(said, model, is_bare, spaced=thai)
        total = len(_compact(said)[0])
        if where:
            _settle_fillers(where, scores, sizes, lambda a, b: _fillers_only_text(said[a:b]), lambda b: is_bare or said[b - 1] in "…." and said[b - 2 : b - 1] in "….", lambda b: False)
        chosen = decode(sizes, scores, total, model.length["c"], is_bare and not thai, None if not where else (lambda a, b: said[where[a] if a >= 0 else 0 : where[b] if b < len(where) else len(said)]))
        cuts = [where[k] for k in chosen]
    else:
        found = [(m.group(), m.end()) for m in _TOKEN.finditer(said)]
        tokens = [t for t, _ in found]
        is_bare = bare(said)
        where, scores = word_candidates(tokens, model, is_bare)
        if not where:
            return []
        sizes = list(where)
        _settle_fillers(where, scores, sizes, lambda a, b: _only_fillers(tokens[a:b]), lambda b: is_bare or tokens[b - 1].endswith(("...", "…")), lambda b: False)
        chosen = decode(sizes, scores, len(tokens), model.length["w"], is_bare, lambda a, b: said[found[where[a] - 1][1] if a >= 0 else 0 : found[where[b] - 1][1] if b < len(where) else len(said)])
        cuts = [found[where[k] - 1][1] for k in chosen]
    out = []
    for e in cuts:
        if not said[e:].strip(_STRIP):
            continue
        out.append(ends_of[e - 1] if ends_of else e)
    return out


#: Last characters of words that count as marked.
MARKED = ".!?…。！？,;:、，；：\"”»」" + M.CLOSERS


def stream_style(words: list[str]) -> tuple[bool, bool, bool]:
    """Whether a stream is written without marks, is of a script without spaces, and holds Thai or Lao."""
    text = "".join(words)
    # Marks stand after one word in six or so; a few survive where they were taken out.
    return sum(1 for w in words if w[-1] in MARKED) <= BARE_SHARE * len(words), M.is_unspaced(text), M.SPACED_SENTENCES.search(text) is not None


def stream_ends(words: list[str], starts, stops, model: Model, style: tuple[bool, bool, bool] | None = None) -> list[int]:
    """Positions in ``words`` of the last word of every sentence of a run, the final one included.

    ``style`` is the :func:`stream_style` of the whole run, where ``words`` is only a part of it.
    """
    n = len(words)
    if n == 0:
        return []
    filled = [w if w and not w.isspace() else "-" for w in words]
    pauses = [float("nan")] * n
    if n > 1:
        gap = np.asarray(starts[1:], dtype=float) - np.asarray(stops[:-1], dtype=float)
        pauses[: n - 1] = gap.tolist()
    is_bare, unspaced, thai = style or stream_style(filled)
    if unspaced:
        text = "".join(filled)
        at, k = [], 0
        for w in filled:
            k += len(w)
            at.append(k)
        index = {e: i for i, e in enumerate(at)}
        where, scores, sizes = char_candidates(text, model, is_bare or thai, at=at, pauses=pauses)
        if where:
            alone = FILLER_PAUSE[is_bare or thai]
            _settle_fillers(where, scores, sizes, lambda a, b: _fillers_only_text(text[a:b]), lambda b: is_bare or thai or text[b - 1] == "…", lambda b: pauses[index[b]] >= alone)
        chosen = decode(sizes, scores, len(_compact(text)[0]), model.length["c"], is_bare and not thai, lambda a, b: text[where[a] if a >= 0 else 0 : where[b] if b < len(where) else len(text)])
        ends = [index[where[k]] for k in chosen]
    else:
        where, scores = word_candidates(filled, model, is_bare, pauses)
        sizes = list(where)
        if where:
            alone = FILLER_PAUSE[is_bare]
            _settle_fillers(where, scores, sizes, lambda a, b: _only_fillers(filled[a:b]), lambda b: is_bare or filled[b - 1].endswith(("...", "…")), lambda b: pauses[b - 1] >= alone and (is_bare or not filled[b][:1].islower()))
        chosen = decode(sizes, scores, n, model.length["w"], is_bare, lambda a, b: " ".join(filled[where[a] if a >= 0 else 0 : where[b] if b < len(where) else n]))
        ends = [where[k] - 1 for k in chosen]
    if not ends or ends[-1] != n - 1:
        ends.append(n - 1)
    return ends


# -- fitting -----------------------------------------------------------------------------------------


def _strip_marks(text: str) -> str:
    return " ".join(w for w in (t.strip(_STRIP) for t in text.lower().split()) if w)


def fit(units: list[str], texts: list[str] = (), seed: int = 7) -> Model:
    """Fit on ``units`` that each hold about one sentence, then again with the sentences found in ``texts``.

    The first model knows marks only; it splits the texts that are written with marks, and their
    sentences join the units, so that the words of unpunctuated texts are learnt from all of them.
    Noise in the units is tolerated; the result depends on the multiset of units and texts only.
    """
    units = list(units)
    if texts:
        first = _fit(units, seed, False)
        for t in sorted(x for x in texts if x):
            said = M.speech(M.unescape(t)[0])
            if bare(said) or _guess(said) == "th":  # nothing here that the first model could go by
                continue
            at = 0
            for e in sentence_ends(said, first):
                units.append(said[at:e])
                at = e
            last = said[at:].strip()
            if last and last[-1] in M.ENDERS + M.CLOSERS:
                units.append(last)
    return _fit(units, seed, True)


def _fit(units: list[str], seed: int, bare_too: bool, rounds: int = 60) -> Model:
    rng = random.Random(seed)
    units = sorted(u for u in (M.speech(M.unescape(x)[0]).strip() for x in units if x) if u.strip(_STRIP))
    rng.shuffle(units)
    spaced = [u for u in units if not M.is_unspaced(u)]
    dense = [u for u in units if M.is_unspaced(u)]
    vocabulary = Counter(w for u in spaced for w in {norm(t) for t in u.split()})
    common = frozenset(w for w, c in vocabulary.items() if c >= 3 and w)
    X: list[list[str]] = []
    y: list[int] = []

    def add(features: list[str], label: int) -> None:
        X.append(features)
        y.append(label)

    # Words between spaces; groups by first letter class keep neighbours in one language most of the time.
    def seams(group: list[str], size: int = 4):
        by: dict[str, list[str]] = {}
        for u in group:
            by.setdefault(_guess(u), []).append(u)
        for us in by.values():
            for i in range(0, len(us) - 1, size - 1):
                yield us[i : i + size]

    for chain in seams(spaced):
        # as written
        tokens: list[str] = []
        cuts = set()
        for u in chain:
            tokens += u.split()
            cuts.add(len(tokens))
        for at, key, extra in marked_words(tokens, common):
            add(_word_features("p", *key) + extra, int(at in cuts))
        if not bare_too:
            continue
        # without case and marks, with fillers in places
        toks: list[str] = []
        cuts = set()
        lang = _guess(chain[0])
        for u in chain:
            ws = _strip_marks(u).split()
            if rng.random() < 0.25:
                f = rng.choice(M.FILLERS.get(lang, M.FILLERS["en"])).split()
                p = 0 if rng.random() < 0.6 else rng.randrange(len(ws) + 1)
                ws[p:p] = f
            toks += ws
            cuts.add(len(toks))
        words = [norm(t) for t in toks]
        for i in range(1, len(words)):
            if i in cuts or rng.random() < 0.6:
                add(_word_features("u", _triple(words, i, common), _triple(words, i + 3, common)), int(i in cuts))
    for chain in seams(dense):
        lang = _guess(chain[0])
        text, cuts = "", set()
        for u in chain:
            gap = " " if lang == "th" else rng.choice(("", "", " "))
            text += (gap if text else "") + u
            cuts.add(len(text))
        letters, ends = _compact(text)
        for at, _, key, extra in marked_chars(text, letters, ends):
            add(_char_features("p", *key) + extra, int(at in cuts))
        if not bare_too:
            continue
        text, cuts = "", set()
        for u in chain:
            v = u if lang == "th" else _PUNCT.sub("", u.lower()) if rng.random() < 0.8 else re.sub(r"[、，；：。！？…“”「」]+", "", u)
            if rng.random() < 0.25:
                v = rng.choice(M.FILLERS.get(lang, M.FILLERS["zh"])) + v
            text += (" " if text else "") + v
            cuts.add(len(_compact(text)[0]))
        letters, ends = _compact(text)
        for i in range(1, len(letters)):
            key = _context(letters, i)
            if i in cuts or rng.random() < 0.6:
                add(_char_features("u", *key), int(i in cuts))
            if lang == "th":
                stop = _skip_marks(text, ends[i - 1])
                if stop < len(text) and text[stop].isspace():
                    add(_char_features("v", *key) + _space_features(text, stop), int(i in cuts))
    lengths = {"w": [len(u.split()) for u in spaced], "c": [len(_compact(u)[0]) for u in dense]}
    length = {}
    for k, v in lengths.items():
        logs = np.log(np.maximum(np.asarray(v or [12.0], dtype=float), 1))
        length[k] = (float(logs.mean()), max(0.5, float(logs.std())))
    return Model(_logistic(X, y, rounds), common, length)


def _guess(text: str) -> str:
    """A coarse language key for chaining units: script, or the commonest telltale letters."""
    for c in text:
        o = ord(c)
        if 0x0E00 <= o <= 0x0EFF:
            return "th"
        if 0x3040 <= o <= 0x30FF:
            return "ja"
    if any(0x3400 <= ord(c) <= 0x9FFF for c in text):
        return "zh"
    low = f" {text.lower()} "
    # Function words by language.
    words = {
        "en": (" the ", " and ", " is ", " we ", " that "),
        "de": (" die ", " und ", " das ", " der ", " wir ", " ist "),
        "fr": (" le ", " la ", " est ", " les ", " et ", " l'", " on "),
        "es": (" el ", " los ", " y ", " la ", " que ", " de "),
        "vi": (" và ", " không ", " là ", " có ", " đã ", " ta ", " số "),
    }
    return max(words, key=lambda k: sum(low.count(w) for w in words[k]))


def _logistic(X: list[list[str]], y: list[int], rounds: int, l2: float = 2.0) -> dict[str, float]:
    """Regularised logistic regression by AdaGrad on the full sample; weights of seldom seen features are left out."""
    counts = Counter(f for x in X for f in x)
    ids = {f: i for i, f in enumerate(sorted(f for f, c in counts.items() if c >= 2))}
    if not ids:
        return {}
    rows = np.fromiter((i for i, x in enumerate(X) for f in x if f in ids), dtype=np.int64)
    cols = np.fromiter((ids[f] for x in X for f in x if f in ids), dtype=np.int64)
    target = np.asarray(y, dtype=float)
    w = np.zeros(len(ids))
    g2 = np.full(len(ids), 1e-3)
    for r in range(rounds):
        z = np.bincount(rows, weights=w[cols], minlength=len(X))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(cols, weights=(p - target)[rows], minlength=len(ids)) + l2 * w
        g2 += g * g
        w -= 0.5 * g / np.sqrt(g2) / (1 + r / rounds)
    return {f: float(w[i]) for f, i in ids.items() if abs(w[i]) > 1e-3}
