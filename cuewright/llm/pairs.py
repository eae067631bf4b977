"""Broken prompt and response pairs (problem 5): ordered rules, each with its own evidence.

In order: emptiness; refusal phrases; a copied prefix, or most of the prompt's words in runs; letters
of a script that neither language of the pair is written in, or, within one script, a language model;
an unclosed delimiter or an abrupt ending, which is a truncation if the model of problem 6 agrees.
Every rule that is met gives its defect.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import base_lang, delivered_once, table
from . import marks as M
from . import truncation as T
from .sentences import _STRIP, _fillers_only_text, _only_fillers, _open_quotes

#: In this order; a pair's first defect is its defect in p5_found.
DEFECTS = ["empty", "refusal", "copy", "wrong_language", "truncated"]
SAMPLE_PAIRS = 5_000
COPY_SHARE = 0.72
LANGUAGE_MARGIN = 4.0

# What stands for a missing text.
PLACEHOLDERS = {"n/a", "na", "null", "none", "nan", "nil", "tbd", "todo", "undefined", "-", "--", "—", "–", "...", "…", "?", "n.a.", "[empty]", "<empty>"}

LONGEST_PLACEHOLDER = max(map(len, PLACEHOLDERS))
#: Spaces, control and format characters, and any letter or digit.
_INVISIBLE = re.compile(r"[\s\x00-\x1f\x7f-\xa0\xad\u200b-\u200f\u2028-\u202e\u2060-\u2064\ufeff]+")
_SAID = re.compile(r"[^\W_]")

# Ways in which an assistant declines, by language. Each needs the act that is declined
# (to translate, help, answer, comply), so that speakers who are sorry or cannot do something stay out.
REFUSALS = re.compile(
    r"""(?:
    \b(?:can(?:no|['’])t|could\s*n['’]t|unable\s+to|not\s+able\s+to|won['’]t|will\s+not|must\s+decline\s+to|refuse\s+to|decline\s+to)\s+(?:be\s+able\s+to\s+)?
      (?:translate|assist|comply|fulfil+|help\s+(?:you|with)|provide\s+(?:a\s+|the\s+|this\s+)?(?:translation|answer|response)|process\s+(?:this|that|the|your)\s+(?:request|text)|complete\s+(?:this|that|the|your)\s+request|respond\s+to|answer\s+(?:this|that)|continue\b)
    | \bas\s+an?\s+(?:ai|artificial|language\s+model|assistant|large\s+language)
    | \b(?:request|content|text)\b.{0,40}\b(?:blocked\s+by|against\s+(?:my|our|the)|violates?)\b.{0,30}\b(?:polic|guideline|rules)
    | \bagainst\s+(?:my|our)\s+(?:guidelines|policy|policies|rules)
    | \b(?:i\s+)?must\s+decline\b | \bi\s+(?:have\s+to|must)\s+refuse\b
    | (?:n['’]t|\bnot)\s+(?:feel\s+|be\s+)?comfortable\b.{0,50}\b(?:line|segment|text|passage|request|translat\w+|render\w*|content)\b
    | \b(?:rather|prefer)\s+not\b.{0,50}\b(?:line|segment|text|passage|request|translat\w+|render\w*|content)\b
    | \bno\s+(?:puedo|podemos|me\s+es\s+posible|es\s+posible|estoy\s+en\s+condiciones\s+de)\s+(?:traducir|ayudar|atender|cumplir|procesar|responder|proporcionar|completar|continuar)
    | \bcomo\s+(?:asistente|modelo\s+de\s+lenguaje|ia)\b | \b(?:debo|tengo\s+que)\s+(?:rechazar|declinar|negarme|rehusar)\b | \bme\s+niego\s+a\b | \bno\s+me\s+siento\s+cómod
    | \bsolicitud\b.{0,40}\b(?:bloquead|rechazad|política)
    | \bne\s+(?:peux|peut|pouvons|puis)\s+pas\s+(?:traduire|vous\s+aider|répondre|fournir|traiter|donner\s+suite|satisfaire|continuer)
    | \bpas\s+en\s+mesure\s+de\s+(?:traduire|répondre|vous\s+aider|fournir|traiter|satisfaire|donner)
    | \ben\s+tant\s+qu['’e]\s*(?:assistant|ia\b|modèle|intelligence) | \bdois\s+(?:refuser|décliner)\b | \bje\s+refuse\s+de\b | \bpas\s+à\s+l['’]aise\b.{0,50}\b(?:réplique|texte|segment|passage|demande|traduire) | \bdemande\b.{0,40}\b(?:bloquée|refusée|politique\s+de)
    | \bkann\s+(?:ich\s+)?(?:diese[nmrs]?|den|das|ihnen|dabei|hierbei)\b.{0,40}\b(?:nicht|leider)\b.{0,30}\b(?:übersetz|helfen|bearbeit|beantwort|erfüll)
    | \bnicht\s+in\s+der\s+lage\b | \bals\s+(?:ki\b|assistent|sprachmodell|künstliche) | \b(?:leider|muss)\b.{0,25}\bablehnen\b | \bweigere\s+mich\b | \bfühle\s+mich\b.{0,20}\b(?:nicht\s+wohl|unwohl)\b | \banfrage\b.{0,40}\b(?:blockiert|abgelehnt|richtlinie)
    | không\s+thể\s+(?:dịch|đáp\s+ứng|hỗ\s+trợ|trợ\s+giúp|thực\s+hiện\s+yêu\s+cầu|xử\s+lý|trả\s+lời|cung\s+cấp|tiếp\s+tục) | là\s+một\s+(?:trợ\s+lý|mô\s+hình|ai\b) | từ\s+chối\s+(?:dịch|tạo|viết|yêu\s+cầu|trả\s+lời|dòng|đoạn|câu) | (?:phải|xin)\s+(?:phép\s+)?từ\s+chối | không\s+(?:cảm\s+)?thấy\s+thoải\s+mái
    | (?:无法|不能|没法|不便|不可以)(?:为您|帮您|帮助您|替您)?(?:翻译|处理(?:这个|此|该)?(?:请求|内容)|提供(?:翻译|这段|该)|协助|回答|满足|完成(?:这个|此|该)?(?:请求|任务)|继续(?:翻译|处理)) | 作为(?:一个|一名)?(?:助手|助理|AI|人工智能|语言模型) | (?:必须|只能|不得不|我得|我要)拒绝 | 拒绝(?:翻译|处理|回答|生成|提供) | 不(?:太)?(?:愿意|方便|适合)(?:翻译|处理|生成|提供) | 请求.{0,8}(?:被拒|被阻|被拦)
    | (?:翻訳|お手伝い|お応え|対応|回答|お答え|処理|提供)(?:することは|は|が|を)?(?:いた|致)?し?(?:でき(?:ません|かね|ない)|かねます) | アシスタントとして | 言語モデルとして | AIとして | (?:ご依頼|リクエスト|この行|この文).{0,12}(?:お断り|ブロック|拒否) | お断り(?:します|いたします|しなければ|せざる) | (?:翻訳|作成|生成|対応)(?:は|を)?(?:差し)?控え(?:ます|させ) | 遠慮させていただ
    | ไม่สามารถ(?:แปล|ทำตาม|ช่วย|ให้คำแปล|ตอบ|ดำเนินการ|ประมวลผล(?:คำขอ|ข้อความ)) | ในฐานะ(?:ผู้ช่วย|โมเดล|ปัญญา|AI) | (?:ต้อง|ขอ)(?:ขอ)?ปฏิเสธ | ไม่(?:สะดวกใจ|สบายใจ) | คำขอ.{0,20}(?:ถูกบล็อก|ถูกปฏิเสธ)
    )""",
    re.I | re.X | re.S,
)

# What every refusal above has one of, in lower case and single-spaced: a cheap test before the long pattern.
_REFUSAL_HINTS = (
    "can't", "can’t", "cannot", "n't", "n’t", "unable", "not able", "comfortable", "won't", "won’t", "will not", "declin", "déclin", "refus", "against", "blocked by", " ai", "an ai", "artificial", "language model", "large language", "assistant", "polic", "guideline", "violat", "rather not", "prefer not",
    "puedo", "podemos", "posible", "condiciones", "asistente", "modelo de", "como ia", "rechaz", "negarme", "rehusar", "niego", "cómod", "solicitud",
    "peux pas", "peut pas", "pouvons pas", "puis pas", "mesure de", "en tant qu", "à l'aise", "à l’aise", "demande", "kann", "in der lage", "als ki", "assistent", "sprachmodell", "künstliche", "ablehn", "weigere", "fühle", "anfrage",
    "không thể", "là một", "từ chối", "thoải mái", "无法", "不能", "没法", "不便", "不可以", "作为", "拒绝", "请求", "不愿", "不方便", "不适合", "不太", "できま", "できな", "できか", "かねます", "アシスタント", "言語モデル", "aiとして", "断り", "ブロック", "拒否", "控え", "遠慮",
    "ไม่สามารถ", "ในฐานะ", "ปฏิเสธ", "คำขอ", "ไม่สะดวก", "ไม่สบาย",
)


def refused(text: str) -> bool:
    low = " ".join(text.lower().replace("ſ", "s").split())
    return any(map(low.__contains__, _REFUSAL_HINTS)) and REFUSALS.search(text) is not None


_WORD = re.compile(r"[^\W_]+(?:['’.-][^\W_]+)*")
_DENSE = re.compile(r"[฀-๿぀-ヿ㐀-鿿豈-﫿]")


def silent(text: str | None) -> bool:
    """Whether nothing is said: null, blank, or only notes, clock times, labels and fillers."""
    if text is None:
        return True
    said = M.speech(M.unescape(text)[0])
    return not said.strip(_STRIP + "​﻿ \n\t") or _only_fillers(said.split()) or _fillers_only_text(said)


def empty(text: str | None) -> bool:
    """No translation: null, blank or invisible characters, a placeholder, or notes only."""
    if text is None:
        return True
    t = M.unescape(text)[0]
    # Only a few visible characters can be a placeholder.
    bare = _INVISIBLE.sub("", t)
    return not bare or len(bare) <= LONGEST_PLACEHOLDER and bare.lower() in PLACEHOLDERS or not _SAID.search(M.speech(t))


def _tokens(text: str) -> list[str]:
    """Words; of scripts without spaces, their characters."""
    said = M.speech(M.unescape(text)[0]).lower()
    if not _DENSE.search(said):
        return _WORD.findall(said)
    out = []
    for w in _WORD.findall(said):
        if _DENSE.search(w):
            for piece in re.findall(r"[฀-๿぀-ヿ㐀-鿿豈-﫿]|[^฀-๿぀-ヿ㐀-鿿豈-﫿]+", w):
                out.append(piece)
        else:
            out.append(w)
    return out


_DIGIT = re.compile(r"\d")


def _is_code(w: str) -> bool:
    return not w.isalpha() and _DIGIT.search(w) is not None


def only_names(tokens: list[str]) -> bool:
    """Whether a text is a series of names with their codes and numbers, as ``talune v24 sonariq-17``."""
    named = 0
    after_code = True
    for w in tokens:
        if _is_code(w):
            named += 1
            after_code = True
        elif len(w) < 2 or _DENSE.search(w) or not after_code:
            return False
        else:
            after_code = False
    return named > 0 and after_code


def copied(prompt: str, response: str, tokens: tuple[list[str], list[str]] | None = None) -> bool:
    """Whether the response repeats the prompt: most of its words, and runs of them, are the prompt's."""
    a, b = tokens if tokens else (_tokens(prompt), _tokens(response))
    if not a or not b or only_names(a):
        return False
    known = set(a)
    if sum(w in known for w in b) < 0.5 * len(b):
        return False
    common = Counter(a) & Counter(b)
    plain = lambda ws: [w for w in ws if not _is_code(w)]
    pa_, pb = plain(a), plain(b)
    if not pa_ or not pb:
        return False
    share = sum(n for w, n in common.items() if not _is_code(w)) / len(pb)
    if share < COPY_SHARE:
        return False
    if len(pb) < 4:  # short: the same text, up to an added word
        return sum((Counter(pa_) & Counter(pb)).values()) >= min(len(pa_), len(pb)) and len(pa_) <= 2 * len(pb) + 2
    pairs = Counter(zip(a, a[1:])) & Counter(zip(b, b[1:]))
    return sum(pairs.values()) / max(1, len(b) - 1) >= COPY_SHARE - 0.22


def copied_prefix(a: list[str], b: list[str]) -> bool:
    """Whether the response opens with the prompt's own opening words, for most of its length."""
    if not a or not b or only_names(a):
        return False
    same = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return same >= 2 and same >= COPY_SHARE * len(b)


# The scripts a language is written in, and the letters of each.
SCRIPTS = {"zh": {"han"}, "ja": {"han", "kana"}, "th": {"thai"}, **dict.fromkeys(("en", "de", "fr", "es", "vi"), {"latin"})}
_LETTERS = {"thai": re.compile("[\u0E00-\u0E7F]"), "kana": re.compile("[\u3040-\u30FF]"), "han": re.compile("[\u3400-\u9FFF\uF900-\uFAFF]"), "latin": re.compile("[A-Za-z\u00C0-\u024F\u1E00-\u1EFF]")}
#: Share of a response's letters in a script from which it counts as written in it; kana stand among others.
SCRIPT_SHARE = {"thai": 0.6, "kana": 0.2, "han": 0.6, "latin": 0.9}


def foreign_script(text: str, source: str | None, target: str | None) -> bool:
    """Whether a response is written in a script of neither language. Languages that are not listed make no mismatch."""
    if source not in SCRIPTS or target not in SCRIPTS:
        return False
    own = SCRIPTS[source] | SCRIPTS[target]
    if own == {"latin"} and not _DENSE.search(text):
        return False
    found = {k: len(rx.findall(text)) for k, rx in _LETTERS.items()}
    total = sum(found.values())
    return total > 3 and any(k not in own and found[k] >= SCRIPT_SHARE[k] * total for k in found)


_SHORT_END = re.compile(r"(?<!\S)\S{1,3}\.$")


def unclosed(said: str) -> bool:
    """A quotation or bracket that is opened and not closed."""
    return _open_quotes(said) > 0 or any(said.rfind(o) > said.rfind(c) for o, c in ("[]", "()", "（）", "【】", "{}"))


def abrupt(said: str) -> bool:
    """An ending without a sentence's final mark, with one that trails off, or with a point that may be an abbreviation's."""
    tail = said.rstrip()
    return not T._ENDED.search(tail) or T._TRAIL.search(tail) is not None or "�" in tail[-3:] or _SHORT_END.search(tail) is not None


class Languages:
    """Multinomial naive Bayes over words and character trigrams, fitted on a bounded labelled sample."""

    def __init__(self, rows: list[tuple[str, str]]):
        counts: dict[str, Counter] = {}
        for lang, text in rows:
            if lang and text:
                counts.setdefault(lang, Counter()).update(self.features(text))
        total = Counter()
        for c in counts.values():
            total.update(c)
        keep = {f for f, n in total.items() if n >= 3}
        self.logs: dict[str, dict[str, float]] = {}
        self.unseen: dict[str, float] = {}
        for lang, c in counts.items():
            n = sum(v for f, v in c.items() if f in keep) + 0.5 * len(keep)
            self.logs[lang] = {f: math.log((v + 0.5) / n) for f, v in c.items() if f in keep}
            self.unseen[lang] = math.log(0.5 / n)
        self.names = sorted(self.logs)
        self.rows: dict[str, np.ndarray] = {}
        for f in keep:
            self.rows[f] = np.array([self.logs[x].get(f, self.unseen[x]) for x in self.names])
        del self.logs
        self.memo: dict[str, np.ndarray | None] = {}

    def __getstate__(self):
        return self.names, self.rows

    def __setstate__(self, s):
        self.names, self.rows = s
        self.memo = {}

    @staticmethod
    def word_features(w: str) -> list[str]:
        p = f"^{w}$"
        return ["w" + w] if _DENSE.match(w) else ["w" + w, *(p[i : i + 3] for i in range(len(p) - 2))]

    @classmethod
    def features(cls, text: str) -> list[str]:
        return [f for w in _tokens(text) if not _is_code(w) for f in cls.word_features(w)]

    def scores(self, words: list[str]) -> dict[str, float]:
        """Log-likelihood of a text's words by language, over the features that were seen in fitting."""
        total = None
        for w in words:
            if w not in self.memo:
                if len(self.memo) > 200_000:
                    self.memo.clear()
                seen = [] if _is_code(w) else [self.rows[f] for f in self.word_features(w) if f in self.rows]
                self.memo[w] = np.sum(seen, axis=0) if seen else None
            v = self.memo[w]
            if v is not None:
                total = v.copy() if total is None else total + v
        return {} if total is None else dict(zip(self.names, total.tolist()))


def wrong_language(words: list[str], source: str | None, target: str | None, known: Languages) -> bool:
    """Whether another language explains the response clearly better than the pair's two languages."""
    if only_names(words):
        return False
    s = known.scores(words)
    if not s:
        return False
    mine = [s[x] for x in (source, target) if x in s]
    if not mine:
        return False
    best = max(s, key=s.get)
    return best not in (source, target) and s[best] - max(mine) > LANGUAGE_MARGIN + 0.15 * len(words)


def defects(prompt: str | None, response: str | None, source: str | None, target: str | None, known: Languages, cut) -> list[str]:
    """Every defect of a pair, in the order of DEFECTS; none where nothing is said in the prompt.

    ``cut()`` tells whether the response was cut; it is asked only where a delimiter is unclosed or
    the ending abrupt.
    """
    if silent(prompt):
        return []
    plain = M.unescape(response)[0] if response else ""
    found = []
    if refused(plain) and not (refused(prompt) and copied(prompt, response)):
        found.append("refusal")
    elif empty(response):
        return ["empty"]
    words = _tokens(response)
    asked = _tokens(prompt)
    if copied_prefix(asked, words) or copied(prompt, response, (asked, words)):
        found.append("copy")
    if not only_names(words) and (foreign_script(plain, source, target) or wrong_language(words, source, target, known)):
        found.append("wrong_language")
    said = M.speech(plain)
    if (abrupt(said) or unclosed(said)) and cut():
        found.append("truncated")
    return found


def pair_defects(df: DataFrame, known: Languages, model: T.Model, limits: dict | DataFrame, keys: list[str]) -> DataFrame:
    """``keys, defects``: the pairs with at least one defect and all of their defects.

    ``df`` holds ``keys, text_src, text_target, feed, source_lang, target_lang``; null texts count as
    empty, null languages leave out the language rule, repeated keys are judged row by row.
    """
    rows, by_source = T.with_limits(df.select(*keys, "text_src", "text_target", "source_lang", "target_lang", "feed"), limits, keys, "feed")
    shared = df.sparkSession.sparkContext.broadcast((known, model, by_source))
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", defects array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, m, lim = shared.value
        for b in batches:
            at, found = [], []
            of = T.limits_of(b, "feed", lim)
            cols = [b.column(c).to_pylist() for c in ("text_src", "text_target", "source_lang", "target_lang")]
            for i, (prompt, response, s, t) in enumerate(zip(*cols)):

                def cut(i=i, response=response) -> bool:
                    x = T.features(response, of(i, "text_target"), m.words)
                    return x is not None and float(m.weights[x].sum()) > m.threshold

                d = defects(prompt, response, s, t, languages, cut)
                if d:
                    at.append(i)
                    found.append(d)
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(k).take(take) for k in keys] + [pa.array(found, pa.list_(pa.string()))], [*keys, "defects"])

    return rows.mapInArrow(run, schema)


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    segments = delivered_once(table(spark, d, "segments", "run_id", "idx", "text_src", "text_target", "feed", "loaded_at"), "run_id", "idx").drop("loaded_at")
    runs = table(spark, d, "runs", "run_id", "source_lang", "target_lang")
    return segments.join(runs.select("run_id", base_lang(F.col("source_lang")).alias("source_lang"), base_lang(F.col("target_lang")).alias("target_lang")), "run_id", "left")


def fit_languages(spark: SparkSession, d: str, most: int = SAMPLE_PAIRS) -> Languages:
    """Fitted on the texts of at most ``most`` segments, labelled with the languages of their runs."""
    segments = table(spark, d, "segments", "run_id", "idx", "text_src", "text_target")
    sample = segments.withColumn("_h", F.xxhash64("run_id", "idx")).orderBy("_h", "text_src", "text_target").limit(most)
    runs = table(spark, d, "runs", "run_id", "source_lang", "target_lang")
    rows = sample.join(runs, "run_id").select("text_src", base_lang(F.col("source_lang")).alias("s"), "text_target", base_lang(F.col("target_lang")).alias("t")).collect()
    return Languages(sorted([(r["s"], r["text_src"]) for r in rows if r["s"] and r["text_src"]] + [(r["t"], r["text_target"]) for r in rows if r["t"] and r["text_target"]]))


def _defects(spark: SparkSession, d: str) -> DataFrame:
    model, limits = T.fit_model(spark, d)
    return pair_defects(_pairs(spark, d), fit_languages(spark, d), model, limits, ["run_id", "idx"])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d).select("run_id", "idx", F.col("defects")[0].alias("defect"))


def p5_all_defects(spark: SparkSession, d: str) -> DataFrame:
    """Every triggered defect type of every pair."""
    return _defects(spark, d).select("run_id", "idx", F.explode("defects").alias("defect"))


QUERIES = {"p5_found": p5_found, "p5_all_defects": p5_all_defects}
ORACLES: dict[str, str] = {}
