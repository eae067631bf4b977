"""Per-document text statistics and what is not running prose (problem 9).

A text is measured as a vector of counts that add up: the vector of a document is the sum of the
vectors of its pieces, corrected where a piece starts inside a word. Documents over PIECE_CHARS are
cut into pieces, measured apart and merged in two levels; a line that was cut is classified whole,
and shares and rule outcomes are derived from the merged counts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import spread, table
from . import marks as M

PIECE_CHARS = 65_536
FAN_IN = 64
#: Smallest hashes of word pairs kept to estimate how many different ones there are.
SKETCH = 64
#: Share of brackets and semicolons from which a text may be keys struck at random.
MASH_SHARE = 0.01

# Function words by language.
COMMON = {
    "en": "the a an and or but of to in on at by for with from is are was were be been it its this that these those i you he she we they not no who which what when while because before after until how there then so as if us our more than about do does did has have had can would could will some every another nobody all after all well maybe now just keep",
    "de": "der die das den dem des ein eine einen und oder aber nicht ist sind war waren sich mit auf in im zu zum zur von vom für wir ich er sie es dass wenn dann weil denn doch also nur ohne am an als wie hat haben wird mehr über etwa pro nie aus so und bevor dort niemand",
    "fr": "le la les l' un une des du de d' et ou mais ne pas est sont était on nous je il elle qui que qu' quand parce car donc dans sur sous avec sans pour par en au aux ce cette c' se s' y a ont plus cela même avant après comme si tout avons jamais",
    "es": "el la los las un una unos de del y o pero no es son era se en con sin para por que qué cuando porque así a al lo su nos como más ya está muy nadie nunca antes desde hasta hay esto eso después",
    "vi": "và là của có không những các một cho đã được với này đó thì mà ở từ vì nên nhưng khi nếu trước sau ta tôi chúng ông bà nó rồi đến cứ mới ai sang hơn như cũng bao chưa trong lúc",
}
COMMON_WORDS = frozenset(w for ws in COMMON.values() for w in ws.split())
# Frequent characters of running Chinese, Japanese and Thai.
COMMON_CHARS = frozenset("的了是在我们有和就不也这那要到从把被着过吗说为以而且但因所如果很都还没谁后先" + "のはをにがでとてもしますたいるれなかっらりへよねさせん" + "่้็์ัิีืุูเแโใไาำอนรมกท")

# What web pages and players leave behind.
UI_WORDS = "undefined NaN null Loading Login Log Sign Subscribe Share Close Play Pause Next Previous Home Menu Search Cookie HD CC Like Download Advertisement Accept".split()
_UI_FORMS = {"Log": "Log in", "Sign": "Sign (?:in|up)", "Cookie": "Cookies?"}
UI = re.compile(
    r"</?[a-zA-Z][^<>\n]{0,40}>|\{\{[^{}\n]{0,30}\}\}|&(?:nbsp|amp|lt|gt|quot);|\b\d{1,2}:\d{2} / \d{1,2}:\d{2}\b|\[x\]|>>|<<|!!!"
    rf"|\b(?:{'|'.join(_UI_FORMS.get(w, w) for w in UI_WORDS)})\b"
)
# Every match of it holds one of these, here by their first characters, which most texts lack.
_UI_HINTS = {c: [h for h in hints if h[0] == c] for hints in [("<", "{{", "&", " / ", "[x]", ">>", "!!!", *UI_WORDS)] for c in dict.fromkeys(h[0] for h in hints)}
#: More characters than a match of UI has.
CONTEXT = 64
_SPACE_WORD = re.compile(r"\S+")
_MARKER = re.compile(r"\s*(?:[•·●▪◦‣*+–—-]|\(?\d{1,4}[.)]|\(?[a-zA-Z][.)]|\[[ xX✓]?\]|☐|☑|[①-⑳]|\d{1,4}[、．])\s*(?=\S)")
# Patterns that open with one set of characters are searched much faster than those that open with a choice or a repetition.
_SENTENCE_END = re.compile(r"[.!?…。！？](?:(?<=[。！？])|[.!?…]*[\"'”’»)\]]*(?=\s|$))")
_ENDERS, _END_CLOSERS = frozenset(".!?…。！？"), "\"'”’“»)]」』）"
_GAPS = re.compile(r"\S(?: {2,}|\t)\S")
_TIGHT = re.compile(r"[,;|](?=\S)|[,;|]$")
_PAIRED = re.compile(r" [-–—=:→] |：| \(\S{1,24}\)$|（[^（）]{1,16}）$")
_INLINE = ";,、；，|/•·"
_DENSE = re.compile(r"[฀-๿぀-ヿ㐀-鿿豈-﫿]")
_MASH = re.compile(r"[a-z][\[\];'\\/<>=][a-z;\[\]]|[\[\];]{2}|(?<!\S)[;'\]][a-z]|[a-z][;\[](?!\S)")
_FIRST = re.compile(r"[^\n]*?(?:[.!?…]+[\"'”’»)\]]*(?=\s)|[。！？][”」』]?)\s*|[^\n]*\n\s*")

# Character classes: 0 symbol, 1 letter, 2 digit, 3 space, 4 letter of an unspaced script, 5 a frequent one, 6 ordinary mark, 7 trace of damage.
# Above these three bits, what counts as a pair of neighbours: a mark or digit (8) before a letter (16), a trace of wrong decoding (32) before anything but a space or a Latin letter (64).
_BROKEN, _DAMAGE = 8, 32
_PAIR_BITS = {_BROKEN: r"[,;~|#§^¤:!?\d]+", 2 * _BROKEN: r"[^\W\d_]+", _DAMAGE: r"[ÃÂÐÑ]+", 2 * _DAMAGE: r"[^a-zA-Z\s]+"}
_CLASSES: list[np.ndarray] = []
_FIRST_CLASSES: list[bytes] = []


def _classes() -> np.ndarray:
    if not _CLASSES:
        t = np.zeros(0x110000, dtype=np.uint8)
        for o in range(0x30000):
            c = chr(o)
            if 0x0E00 <= o <= 0x0E7F or 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF:
                t[o] = 4
            elif c.isalpha():
                t[o] = 1
            elif c.isdigit():
                t[o] = 2
            elif c.isspace():
                t[o] = 3
        for c in ".,;:!?'\"()“”‘’„«»…、。，；：！？「」『』（）¿¡–—-_・ー":
            t[ord(c)] = 6
        for c in COMMON_CHARS:
            t[ord(c)] = 5
        for c in "�¤§¦¬±¶~^#":
            t[ord(c)] = 7
        t[0x00:0x09] = t[0x0B:0x0D] = t[0x0E:0x20] = t[0x7F:0xA0] = 7
        every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
        for bit, pattern in _PAIR_BITS.items():
            for m in re.finditer(pattern, every):
                t[m.start() : m.end()] |= bit
        _FIRST_CLASSES.append(t[:256].tobytes())
        _CLASSES.append(t)
    return _CLASSES[0]


NAMES = [
    "chars", "letters", "digits", "spaces", "symbols", "weird", "words", "word_chars", "common", "ends", "separators", "lines", "ended_lines",
    "entry_lines", "marked_lines", "table_lines", "ui", "blob_chars", "pairs", "dense", "dense_common", "brackets", "mash", "broken", "strong", *(f"short{k}" for k in range(10)),
]
AT = {n: i for i, n in enumerate(NAMES)}
_LINES, _ENDS, _ENDED_LINES, _ENTRY_LINES, _MARKED_LINES, _TABLE_LINES, _SHORT0 = (AT[n] for n in ("lines", "ends", "ended_lines", "entry_lines", "marked_lines", "table_lines", "short0"))


def _entry(line: str, words: list[str], dense: int) -> tuple[bool, bool, str, bool]:
    """Whether a line looks like an entry of a list, whether it opens with a list marker, the line without it, and whether that closes like a sentence."""
    m = _MARKER.match(line)
    core = line[m.end() :] if m else line
    n = 0 if dense else len(core.split()) if m else len(words)
    ended = _ended(core)
    if ended and (n > 3 or dense > 12):
        return False, m is not None, core, ended
    short = n <= 4 if not dense else dense <= 12
    limit = n <= 12 if not dense else dense <= 40
    return (short or limit and _PAIRED.search(core) is not None or m is not None and (n <= 6 or 0 < dense <= 16)), m is not None, core, ended


def _ended(line: str) -> bool:
    """Whether a line closes with the mark of a sentence, quotes and brackets after it aside."""
    return line.rstrip().rstrip(_END_CLOSERS)[-1:] in _ENDERS


def _table(line: str, n_words: int) -> bool:
    tabs, bars = line.count("\t"), line.count("|")
    if tabs >= 2 or bars >= 2:
        return True
    if tabs or "  " in line:
        gaps = len(_GAPS.findall(line))
        # Columns kept apart by spaces hold a few words each; loose spacing in prose does not.
        if gaps >= 2 and n_words <= 3 * (gaps + 1) and not _SENTENCE_END.search(line):
            return True
    if bars + line.count(",") + line.count(";") < 3:
        return False
    tight = len(_TIGHT.findall(line))
    return tight >= 3 and tight >= 0.25 * (line.count(" ") + 1)


_TRIM = ".,;:!?'\"()“”«»…"


def _hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


class _Tokens(dict):
    """Of each token in lower case: the hash of its word, and above these 32 bits whether it is a function word.

    Worked out once; forgotten where there are too many, and never kept for a very long one.
    """

    def __missing__(self, token: str) -> int:
        w = token.strip(_TRIM)
        # d'accord, l'analyse: the article counts
        x = _hash(w) | (w in COMMON_WORDS or "'" in w and w[: w.index("'") + 1] in COMMON_WORDS) << 32
        if len(token) <= 64:
            if len(self) > 200_000:
                self.clear()
            self[token] = x
        return x


_TOKENS = _Tokens()


def _crc_steps() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC_STEPS = _crc_steps()
#: The bits of the first byte by the number of bytes of a character in UTF-8.
_LEAD = np.array([0, 0, 0xC0, 0xE0, 0xF0], dtype=np.uint32)


def _crc_feed(crc: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The running CRC of each place after one more character there."""
    length = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
    for k in range(int(length.max(initial=0))):
        byte = codes >> (6 * np.maximum(length - 1 - k, 0)).astype(np.uint32)
        byte = byte & 0x3F | 0x80 if k else byte | _LEAD[length]
        crc = np.where(length > k, _CRC_STEPS[(crc ^ byte) & 0xFF] ^ crc >> 8, crc)
    return crc


def _two_characters(text: str) -> np.ndarray:
    """The hash of every two neighbouring characters, as :func:`_hash` gives it."""
    codes = _codes(text)
    start = np.full(max(0, len(codes) - 1), 0xFFFFFFFF, dtype=np.uint32)
    return (_crc_feed(_crc_feed(start, codes[:-1]), codes[1:]) ^ np.uint32(0xFFFFFFFF)).astype(np.uint64)


_LEFT, _RIGHT, _HALF, _LOW_HALF = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 32, 0xFFFFFFFF], dtype=np.uint64)


def _pairs(h: np.ndarray) -> np.ndarray:
    """32-bit hashes of neighbours among hashed words."""
    return (h[:-1] * _LEFT + h[1:] * _RIGHT) >> _HALF


def _least(h: np.ndarray) -> list[int]:
    """The smallest different values, SKETCH at most."""
    h = np.sort(h.astype(np.uint32))
    new = np.ones(len(h), dtype=bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new][:SKETCH].tolist()


def _edge_words(text: str, unspaced: bool) -> tuple[str, str]:
    """First and last word as they enter word pairs; two characters at either end for a script without spaces."""
    if unspaced:
        return text[:2], text[-2:]
    head, tail = text.split(None, 1), text.rsplit(None, 1)
    trim = lambda w: w.lower().strip(_TRIM)
    return (trim(head[0]), trim(tail[-1])) if head and tail else ("", "")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _marked(text: str) -> np.ndarray:
    """Class and pair bits of each character."""
    table = _classes()
    try:
        return np.frombuffer(text.encode("latin-1").translate(_FIRST_CLASSES[0]), dtype=np.uint8)
    except UnicodeEncodeError:
        return table[_codes(text)]


def _kinds(marked: np.ndarray) -> np.ndarray:
    """How many characters are of each class."""
    return np.bincount(marked & 7, minlength=8)


def _unspaced(kinds: np.ndarray) -> bool:
    dense = int(kinds[4] + kinds[5])
    return dense * 3 > int(kinds[1]) + dense


def _count_line(v: list[int], line: str, dense: bool) -> None:
    words = line.split()
    if not words:
        return
    d = len(_DENSE.findall(line)) if dense else 0
    d = d if d * 3 > len(line) else 0
    entry, marked, core, ended = _entry(line, words, d)
    v[_LINES] += 1
    v[_ENDS] += len(_SENTENCE_END.findall(core))
    v[_ENDED_LINES] += _ended(line) if marked else ended
    v[_ENTRY_LINES] += entry
    v[_MARKED_LINES] += marked
    v[_TABLE_LINES] += _table(line, len(words))
    v[_SHORT0 + min(9, len(words) if not d else d // 3)] += 1


def measure(text: str, pairs: set[int] | None = None, opened: bool = False, left_open: bool = False, unspaced: bool | None = None, around: tuple[str, str] | None = None, mash: bool = True) -> np.ndarray:
    """The count vector of a piece of text; hashes of its word pairs go into ``pairs``.

    ``around`` holds the CONTEXT characters before and after a piece; what is counted are the matches
    that begin in it. ``mash`` may be left out where :func:`_may_mash` says so.

    The first line of a piece that starts inside a line (``opened``) and the last of one that ends
    inside a line (``left_open``) are not counted as lines here; :func:`cut_lines` does. ``unspaced``
    is whether the whole text counts as a script without spaces, by default judged by ``text``.
    """
    v = [0] * len(NAMES)
    n = len(text)
    if not n:
        return np.array(v, dtype=np.int64)
    marked = _marked(text)
    neighbours = marked[:-1] & (marked[1:] >> 1)
    kinds = _kinds(marked)
    symbols, letters, digits, spaces, plain_dense, common_dense, _, damage = kinds.tolist()
    dense = plain_dense + common_dense
    lower = text.lower()
    low = lower.split()
    # One capital letter becomes two characters.
    tokens = low if len(lower) == n else text.split()
    v[AT["chars"]], v[AT["letters"]], v[AT["dense"]] = n, letters + dense, dense
    v[AT["digits"]], v[AT["spaces"]], v[AT["dense_common"]] = digits, spaces, common_dense
    v[AT["symbols"]] = symbols + damage
    v[AT["weird"]] = damage + int(np.count_nonzero(neighbours & _DAMAGE))
    v[AT["words"]] = len(tokens)
    sizes = list(map(len, tokens))
    v[AT["word_chars"]] = sum(sizes)
    known = np.fromiter(map(_TOKENS.__getitem__, low), np.uint64, len(low))
    v[AT["common"]] = int(np.count_nonzero(known > _LOW_HALF))
    v[AT["separators"]] = sum(map(text.count, _INLINE))
    v[AT["strong"]] = sum(map(text.count, ";|；"))
    near = text if around is None else around[0] + text + around[1]
    if any(c in near and any(map(near.__contains__, hints)) for c, hints in _UI_HINTS.items()):
        lo = len(around[0]) if around else 0
        v[AT["ui"]] = sum(lo <= m.start() < lo + n for m in UI.finditer(near))
    if sizes and max(sizes) > 28:
        v[AT["blob_chars"]] = sum(k for t, k in zip(tokens, sizes) if k > 28 and not _DENSE.search(t))
    v[AT["brackets"]] = sum(map(text.count, "[];"))
    if mash:
        v[AT["mash"]] = len(_MASH.findall(text))
    v[AT["broken"]] = int(np.count_nonzero(neighbours & _BROKEN))
    v[AT["pairs"]] = max(0, len(low) - 1)
    if pairs is not None:
        if _unspaced(kinds) if unspaced is None else unspaced:
            known = _two_characters(text)
            v[AT["pairs"]] = max(0, len(known) - 1)
        if len(known) > 1:
            pairs.update(_least(_pairs(known & _LOW_HALF)))
    lines = text.split("\n")
    for line in lines[int(opened) : len(lines) - left_open]:
        _count_line(v, line, dense > 0)
    return np.array(v, dtype=np.int64)


_TWO_DENSE = re.compile(f"(?<={_DENSE.pattern})(?={_DENSE.pattern})")
_BLANK = re.compile(r"[ \t\n]")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[tuple[str, bool, bool]]:
    """Cuts of a long text: (piece, starts inside a line, starts inside a word).

    A piece ends after a line, else after a blank, else between two letters of a script without
    spaces, so no word or mark of another script is ever cut; without such a place in its second half
    it is longer, up to the next one.
    """
    at, n = 0, len(text)
    in_line = in_word = False
    while at < n:
        end = min(n, at + size)
        line = word = False
        if end < n:
            half = at + max(1, size // 2)
            cut = text.rfind("\n", half, end) + 1 or max(text.rfind(" ", half, end), text.rfind("\t", half, end)) + 1
            if not cut:
                inside = [m.start() for m in _TWO_DENSE.finditer(text, half, end)]
                later = _BLANK.search(text, end)
                dense = _TWO_DENSE.search(text, end)
                cut = inside[-1] if inside else min(later.end() if later else n, dense.start() if dense else n)
            end = cut
            line = end < n and text[end - 1] != "\n"
            word = line and not text[end - 1].isspace()
        yield text[at:end], in_line, in_word
        at, in_line, in_word = end, line, word


def cut_lines(text: str, size: int = PIECE_CHARS) -> Iterator[tuple[str, str, str, bool, bool, bool, list[int]]]:
    """The pieces of a text: (piece, what stands before and after it, starts inside a line, ends inside one, starts inside a word, counts of the line left open).

    A line that was cut is counted whole, with the piece in which it starts.
    """
    at = 0
    cuts = pieces(text, size)
    now = next(cuts, None)
    while now is not None:
        after = next(cuts, None)
        piece, in_line, in_word = now
        end = at + len(piece)
        left_open = after is not None and after[1]
        v = [0] * len(NAMES)
        start = piece.rfind("\n") + 1
        if left_open and (start or not in_line):
            stop = text.find("\n", end)
            _count_line(v, text[at + start : stop if stop >= 0 else len(text)], True)
        yield piece, text[max(0, at - CONTEXT) : at], text[end : end + CONTEXT], in_line, left_open, in_word, v
        at, now = end, after


def smallest(hashes, k: int = SKETCH) -> list[int]:
    return sorted(set(hashes))[:k]


def join_pieces(a: tuple, b: tuple) -> tuple:
    """Associative merge of (vector, sketch, starts inside a word, script without spaces, first word, last word).

    Counts add; a word that was cut counts once; the pairs over the seam are added. In scripts
    without spaces these are runs of characters, and the edges hold two of them.
    """
    v = a[0] + b[0]
    seam = []
    if b[2]:
        v[AT["words"]] -= 1
    if a[3]:
        low = _two_characters(a[5] + b[4])
        if len(low) > 1:
            v[AT["pairs"]] += len(low) - 1
            seam = _pairs(low).tolist()
        return v, smallest([*a[1], *b[1], *seam]), a[2], a[3], (a[4] + b[4])[:2], (a[5] + b[5])[-2:]
    if not b[2] and a[5] and b[4]:
        v[AT["pairs"]] += 1
        seam = _pairs(np.array([_hash(a[5]), _hash(b[4])], dtype=np.uint64)).tolist()
    return v, smallest([*a[1], *b[1], *seam]), a[2], a[3], a[4] or b[4], b[5] or a[5]


def distinct_pairs(sketch: list[int], k: int = SKETCH) -> float:
    """Different word pairs, exact below ``k`` and estimated from the k-th smallest hash above."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((sketch[k - 1] + 1) / 2**32)


def outcome(v: np.ndarray, distinct: float) -> str:
    """``prose``, ``list``, ``table`` or ``junk`` of a count vector."""
    g = dict(zip(NAMES, v.tolist())).__getitem__
    lines, words, chars = max(g("lines"), 1.0), max(g("words"), 1.0), max(g("chars"), 1.0)
    visible = max(chars - g("spaces"), 1.0)
    dense = g("dense") * 3 > g("letters")
    common = g("dense_common") / max(g("dense"), 1.0) if dense else g("common") / words
    if g("letters") + g("digits") == 0:
        return "junk"
    if g("table_lines") >= 0.6 * lines and g("table_lines") >= 2:
        return "table"
    if g("weird") > 0.04 * visible:
        return "junk"
    if g("blob_chars") > 0.5 * visible and not dense:
        return "junk"
    if g("brackets") > MASH_SHARE * chars and g("mash") > 0.2 * words and common < 0.12 and not dense:
        return "junk"
    if g("broken") > 0.18 * words and not dense and g("entry_lines") < 0.5 * lines:
        return "junk"
    if g("ui") > 0.22 * words and g("ui") >= 3:
        return "junk"
    sentences = g("ends")
    # Long texts repeat their pairs by nature; a real one has many different ones all the same.
    repeated = distinct < min(0.12 * g("pairs"), 2000)
    if repeated and g("entry_lines") < 0.6 * lines and g("separators") < 0.15 * words and g("pairs") >= 20:
        return "junk"
    if lines >= 3 and g("entry_lines") >= 0.75 * lines and sentences < 0.34 * lines:
        few = sum(g(f"short{k}") for k in range(5))
        if g("marked_lines") >= 0.6 * lines or few >= 0.75 * lines or g("entry_lines") >= 0.95 * lines:
            return "list"
    units = g("dense") / 5 if dense else words
    if g("separators") >= 5 and g("separators") >= (0.22 if not dense else 0.5) * units and sentences < 0.25 * g("separators"):
        return "list"
    if g("strong") >= 5 and g("strong") >= 0.1 * units and sentences < 0.1 * g("strong"):
        return "list"
    if not dense and words >= 8 and common < 0.03 and sentences < 0.05 * words and g("entry_lines") < 0.5 * lines:
        return "junk"
    return "prose"


def _may_mash(text: str) -> bool:
    """Whether :func:`outcome` looks at ``mash`` at all."""
    return sum(map(text.count, "[];")) > MASH_SHARE * len(text)


def split_first(text: str) -> tuple[str, str]:
    """The first sentence or line, and the rest; no split where nothing would be left."""
    m = _FIRST.match(text.lstrip())
    body = text.lstrip()
    if not m or len(body) - m.end() < 0.4 * len(body):
        return "", body
    return body[: m.end()], body[m.end() :]


def kind(first: np.ndarray, rest: np.ndarray, distinct: float) -> str:
    """The outcome of a document: a single sentence ahead does not count."""
    k = outcome(rest, distinct)
    if k != "prose" or not first.any():
        return k
    return outcome(first + rest, distinct)


STATS = "n_chars bigint, n_words bigint, n_lines bigint, n_sentence_ends bigint, mean_word_length double, symbol_ratio double, digit_ratio double, ended_line_share double, common_share double, distinct_pair_share double, kind string"


def _stats(first: np.ndarray, rest: np.ndarray, sketch: list[int]) -> tuple:
    v = first + rest
    g = dict(zip(NAMES, v.tolist())).__getitem__
    share = lambda a, b: a / b if b else None
    d = distinct_pairs(sketch)
    dense = g("dense") * 3 > g("letters")
    common = share(g("dense_common"), g("dense")) if dense else share(g("common"), g("words"))
    return (
        int(g("chars")), int(g("words")), int(g("lines")), int(g("ends")), share(g("word_chars"), g("words")), share(g("symbols"), g("chars")), share(g("digits"), g("chars")),
        share(g("ended_lines"), g("lines")), common, min(1.0, d / g("pairs")) if g("pairs") else None, kind(first, rest, d) if v.any() else "junk",
    )


def document_stats(docs: DataFrame, key: str = "doc_id", text: str = "text", piece: int = PIECE_CHARS) -> DataFrame:
    """``key`` and the statistics of each document, one row per input row.

    Null and empty texts are ``junk`` with zero counts and null shares. Documents up to ``piece``
    characters are measured in one narrow pass without a shuffle. Longer ones are cut, their pieces
    spread over the cluster, and merged in two levels of FAN_IN.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    names = [key, *(c.split(" ")[0] for c in STATS.split(", "))]
    types = pa.schema([(n, {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[t]) for n, t in (c.split(" ") for c in STATS.split(", "))])

    def rows(keys: pa.Array, stats: list[tuple]) -> pa.RecordBatch:
        cols = [pa.array([s[i] for s in stats], types.field(i).type) for i in range(len(types))]
        return pa.RecordBatch.from_arrays([keys, *cols], names)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t in b.column(text).to_pylist():
                pairs: set[int] = set()
                t = t or ""
                first, rest = split_first(t)
                mash = _may_mash(rest) or _may_mash(first + rest)
                out.append(_stats(measure(first, mash=mash), measure(rest, pairs, mash=mash), smallest(pairs)))
            yield rows(b.column(key), out)

    source = docs.select(key, text)
    long = F.length(text) > piece
    small = source.where(~F.coalesce(long, F.lit(False))).mapInArrow(whole, f"{key} {kinds[key]}, {STATS}")

    state = f"{key} {kinds[key]}, part bigint, counts array<bigint>, sketch array<bigint>, in_word boolean, unspaced boolean, head string, tail string"
    columns = [key, "part", "counts", "sketch", "in_word", "unspaced", "head", "tail"]
    piece_names = [key, "part", "piece", "before", "after", "in_line", "left_open", "in_word", "unspaced", "line_counts"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column(text).to_pylist()):
                k = b.column(key).slice(i, 1)
                first, rest = split_first(t)
                unspaced = _unspaced(sum(_kinds(_marked(p)) for p, *_ in pieces(rest, piece)))
                whole_first = (first, "", "", False, False, False, [0] * len(NAMES))
                for part, (p, before, after, *flags, counts) in enumerate([whole_first, *cut_lines(rest, piece)]):
                    yield pa.RecordBatch.from_arrays([k, pa.array([part]), pa.array([p]), pa.array([before]), pa.array([after]), *(pa.array([f]) for f in (*flags, unspaced)), pa.array([counts], pa.list_(pa.int64()))], piece_names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, sketches, edges = [], [], []
            for part, p, before, after, in_line, left_open, unspaced, line_counts in zip(*(b.column(c).to_pylist() for c in ("part", "piece", "before", "after", "in_line", "left_open", "unspaced", "line_counts"))):
                pairs: set[int] = set()
                counts.append((measure(p, pairs, in_line, left_open, unspaced, (before, after)) if part else measure(p)) + np.asarray(line_counts, dtype=np.int64))
                sketches.append(smallest(pairs))
                edges.append(_edge_words(p, unspaced))
            yield pa.RecordBatch.from_arrays(
                [b.column(key), b.column("part"), pa.array([c.tolist() for c in counts], pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64())), b.column("in_word"), b.column("unspaced"), pa.array([e[0] for e in edges]), pa.array([e[1] for e in edges])],
                columns,
            )

    def states(pdf) -> list[tuple]:
        return [(np.asarray(c, dtype=np.int64), list(s), *rest) for c, s, *rest in zip(*(pdf[c] for c in columns[2:]))]

    def merge(pdf):
        pdf = pdf.sort_values("part")
        all_ = states(pdf)
        done = all_[0]
        for s in all_[1:]:
            done = join_pieces(done, s)
        return type(pdf)([(pdf[key].iloc[0], int(pdf["part"].iloc[0]), done[0].tolist(), *done[1:])], columns=columns)

    def finish(pdf):
        pdf = pdf.sort_values("part")
        all_ = states(pdf)
        first, done = all_[0], all_[1]
        for s in all_[2:]:
            done = join_pieces(done, s)
        return type(pdf)([(pdf[key].iloc[0], *_stats(first[0], done[0], done[1]))], columns=names)

    cuts = source.where(long).mapInArrow(cut, f"{key} {kinds[key]}, part bigint, piece string, before string, after string, in_line boolean, left_open boolean, in_word boolean, unspaced boolean, line_counts array<bigint>")
    parts = cuts.repartition(key, "part").mapInArrow(count, state)
    # The first sentence (part 0) stays apart; the others merge in groups, then together.
    level = parts.withColumn("_group", F.when(F.col("part") > 0, F.floor((F.col("part") - 1) / FAN_IN)).otherwise(F.lit(-1)))
    once = level.groupBy(key, "_group").applyInPandas(lambda pdf: merge(pdf.drop(columns="_group")), state)
    return small.unionByName(once.groupBy(key).applyInPandas(finish, f"{key} {kinds[key]}, {STATS}"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return document_stats(spread(table(spark, d, "documents", "doc_id", "text"))).where("kind <> 'prose'").select("doc_id", "kind")


def p9_stats(spark: SparkSession, d: str) -> DataFrame:
    """All statistics of all documents."""
    return document_stats(spread(table(spark, d, "documents", "doc_id", "text")))


QUERIES = {"p9_found": p9_found, "p9_stats": p9_stats}
ORACLES: dict[str, str] = {}
