"""What is in a stored text besides speech: sound notes, time marks, fillers, escapes, closing marks."""

from __future__ import annotations

import html
import re

# Characters that end a sentence, that may close it after the mark, and quote pairs.
ENDERS = ".!?…。！？｡"
CLOSERS = "\"'”’»)]}」』】）〉》"
QUOTE_PAIRS = {"“": "”", "«": "»", "„": "“", "「": "」", "『": "』", "‹": "›"}
INNER_MARKS = ",;:、，；："

# Hesitation sounds and discourse fillers by language.
FILLERS = {
    "en": ["um", "uh", "er", "hmm", "erm", "you know", "uhm", "ah", "eh", "mm"],
    "de": ["äh", "ähm", "hm", "tja", "öh"],
    "fr": ["euh", "heu", "hein", "ben", "bah"],
    "es": ["eh", "este", "o sea", "em", "pues"],
    "vi": ["ờ", "ơ", "à", "ừm", "ừ"],
    "zh": ["嗯", "呃", "啊", "那个", "额", "哦"],
    "ja": ["えーと", "あの", "ええ", "えっと", "うーん", "あのう"],
    "th": ["เอ่อ", "อืม", "อ่า", "แบบว่า", "เออ"],
}

#: Bracketed or starred remarks of up to 40 characters, music notes, clock times.
NOTE = re.compile(r"\[[^\[\]\n]{0,40}\]|【[^】\n]{0,40}】|\{[^{}\n]{0,40}\}|<[^<>\n]{1,40}>|\*[^*\n]{1,40}\*|♪[^♪\n]{0,40}♪|[♪♫]+|＜[^＜＞\n]{1,40}＞|［[^［］\n]{0,40}］|〔[^〔〕\n]{0,40}〕|\([^()\n]{1,40}\)|（[^（）\n]{1,40}）")
CLOCK = re.compile(r"(?<![\d:.])(?:\d{1,2}:)?\d{1,2}:\d{2}(?:[.,]\d{1,3})?(?![\d:])(?: -(?= ))?")
ESCAPE = re.compile(r"&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[a-zA-Z]{2,8});")
#: A speaker label that opens a value.
LABEL = re.compile(r"\s*(?:(?:>>|[-–—])\s*)?(?:(?:[Ss]peaker|SPEAKER|Spkr\.?)[ _-]?[A-Z0-9]{1,2}|[A-ZÀ-Þ][\w'’-]*(?: [A-ZÀ-Þ][\w'’-]*){0,2})\s?:\s")


def unescape(text: str) -> tuple[str, list[int] | None]:
    """The text without character escapes and, if there were any, the stored end of each character."""
    if "&" not in text or not ESCAPE.search(text):
        return text, None
    out: list[str] = []
    ends: list[int] = []
    at = 0
    for m in ESCAPE.finditer(text):
        plain = html.unescape(m.group())
        if plain == m.group():
            continue
        out.append(text[at : m.start()])
        ends.extend(range(at + 1, m.start() + 1))
        out.append(plain)
        ends.extend([m.end()] * len(plain))
        at = m.end()
    out.append(text[at:])
    ends.extend(range(at + 1, len(text) + 1))
    return "".join(out), ends


def _blank(m: re.Match) -> str:
    return " " * (m.end() - m.start())


def _blank_note(m: re.Match) -> str:
    s = m.group()
    # A parenthesis that belongs to the sentence stays: it follows a letter without a space, or is long prose.
    if s[0] in "(（" and (m.start() and not m.string[m.start() - 1].isspace() or s.count(" ") > 2):
        return s
    return " " * len(s)


def speech(text: str) -> str:
    """The text with notes, clock times and an opening speaker label blanked, at its old length."""
    if any(c in text for c in "[【{<*♪♫＜［〔(（"):
        text = NOTE.sub(_blank_note, text)
    if ":" in text:
        text = CLOCK.sub(_blank, text)
        m = LABEL.match(text)
        if m:
            text = " " * (m.end() - m.start()) + text[m.end() :]
    return text


#: Scripts without spaces between words that put spaces between sentences.
SPACED_SENTENCES = re.compile("[\u0E00-\u0EFF]")
_UNSPACED = re.compile("[\u0E00-\u0EFF\u3040-\u30FF\u3400-\u9FFF\uF900-\uFAFF]")
_LETTER = re.compile(r"[^\W\d_]")


def is_unspaced(text: str) -> bool:
    """Whether most letters of the text are of a script written without spaces between words."""
    if text.isascii():
        return False
    dense = len(_UNSPACED.findall(text))
    # One such character stands for several letters.
    return bool(dense) and dense * 3 > len(_LETTER.findall(text)) - dense
