"""Scalar text functions as Column expressions (JVM side, no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks that end a sentence, signs that may close it, words that carry no content.
SENTENCE_END = r"""[.!?…]["')\]}»”’]*$"""
STOPWORDS = (
    "a an the this that these those is are was were be been being am i you he she it we they me him her us them my your his its our their "
    "and or but so nor yet of in on at to for from by with as if than then do does did done have has had having will would shall should can could "
    "may might must not no yes uh um oh"
).split()


def strip(c: Column) -> Column:
    """Outer whitespace of any kind off (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def ends_sentence(c: Column) -> Column:
    return F.coalesce(c.rlike(SENTENCE_END), F.lit(False))


def normalize(c: Column) -> Column:
    """Lower-case words without marks; letters, digits, underscore and apostrophe stay."""
    bare = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s']", " ")
    return F.filter(F.split(bare, r"\s+"), lambda t: t != "")


def tokens(c: Column) -> Column:
    """Runs of letters, digits, underscores and apostrophes in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_']+)"), 1)


def whitespace_words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def sentences(c: Column) -> Column:
    """Cut after an end mark that is followed by whitespace."""
    return F.filter(F.split(strip(c), r"(?<=[.!?…])\s+"), lambda t: t != "")


def clauses(c: Column) -> Column:
    return F.filter(F.split(strip(c), r"(?<=[,;:])\s+"), lambda t: t != "")


def syllables(c: Column) -> Column:
    """One per whitespace word; a word with digits counts one and a half per digit, half to even; at least 1."""
    digits = lambda t: F.length(t) - F.length(F.translate(t, "0123456789", ""))
    # One and a half per digit, half to even, is at least 1 as soon as there is a digit.
    each = F.transform(F.transform(whitespace_words(c), digits), lambda n: F.when(n > 0, F.bround(n * F.lit(1.5)).cast("int")).otherwise(F.lit(1)))
    return F.greatest(F.lit(1), F.aggregate(each, F.lit(0), lambda a, x: a + x))


def chars(c: Column) -> Column:
    return F.greatest(F.lit(1), F.length(strip(c)))


def skippable(c: Column) -> Column:
    """Blank tokens and ``<...>`` markers."""
    t = strip(c)
    return (t == "") | t.rlike(r"^<.*>$")


def clock(millis: Column) -> Column:
    """``HH:MM:SS,mmm`` of whole milliseconds; negative times are zero."""
    t = F.greatest(F.coalesce(millis, F.lit(0)), F.lit(0)).cast("bigint")
    part = lambda x: F.floor(x).cast("bigint")
    return F.format_string("%02d:%02d:%02d,%03d", part(t / 3600000), part((t % 3600000) / 60000), part((t % 60000) / 1000), t % 1000)


def parse_clock(c: Column) -> Column:
    """Whole milliseconds of ``HH:MM:SS,mmm`` or ``HH:MM:SS.mmm``; null where it is written otherwise."""
    rx = r"^(\d{2}):(\d{2}):(\d{2})[,.](\d{3})$"
    g = lambda i: F.regexp_extract(c, rx, i).cast("bigint")
    return F.when(c.rlike(rx), ((g(1) * 60 + g(2)) * 60 + g(3)) * 1000 + g(4))


def strict_clock(c: Column) -> Column:
    """As :func:`parse_clock`, but a time that is written otherwise is an error; null stays null."""
    bad = F.raise_error(F.concat(F.lit("no subtitle time: "), c)).cast("bigint")
    return F.when(c.isNull(), None).otherwise(F.coalesce(parse_clock(c), bad))


def base_tag(c: Column) -> Column:
    return F.lower(F.trim(F.element_at(F.split(c, "-"), 1)))


def pair_list(c: Column) -> Column:
    """``A=x, B=y`` as a map; parts without both sides are left out, the last of equal keys stays."""
    kv = F.transform(F.split(c, ","), lambda p: F.struct(strip(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), strip(F.regexp_replace(p, "^[^=]*=", ""))).alias("v")))
    good = F.filter(kv, lambda p: (p["k"] != "") & p["v"].isNotNull() & (p["v"] != ""))
    keys = F.array_distinct(F.transform(good, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(good, lambda p: p["k"] == k), -1)["v"]))


def comma_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), strip), lambda t: t != "")


def keyword_line(c: Column) -> Column:
    """The terms of the first ``KEYWORDS:`` line."""
    line = F.regexp_extract(c, r"(?im)^[ \t]*KEYWORDS[ \t]*:[ \t]*([^\r\n]*)", 1)
    return F.filter(F.transform(F.split(line, ";"), strip), lambda t: t != "")


def without_keyword_line(c: Column) -> Column:
    """The text without its first ``KEYWORDS:`` line; later ones stay."""
    at = F.regexp_instr(c, F.lit(r"(?im)^[ \t]*KEYWORDS[ \t]*:[ \t]*[^\r\n]*"))
    line = F.regexp_extract(c, r"(?im)^[ \t]*KEYWORDS[ \t]*:[ \t]*[^\r\n]*", 0)
    return strip(F.when(at > 0, F.concat(F.substring(c, F.lit(1), at - 1), F.substring(c, at + F.length(line), F.length(c)))).otherwise(c))


def keyword_prompt(terms: Column, base: str, most: int) -> Column:
    """``base`` with the first ``most`` non-blank terms named after it."""
    kept = F.slice(F.filter(F.transform(terms, strip), lambda t: t != ""), 1, most)
    return F.when(F.size(kept) > 0, F.concat(F.lit(base + " Keywords: "), F.concat_ws(", ", kept))).otherwise(F.lit(base))


def context_text(**parts: Column) -> Column:
    """Labelled non-empty parts, one per line."""
    return F.concat_ws("\n", *[F.when(strip(c) != "", F.concat(F.lit(label.replace("_", " ") + ": "), c)) for label, c in parts.items()])


def embedded_json(c: Column) -> Column:
    """The first JSON array or object in a reply, inside a fence if there is one; what follows it is left out.

    Brackets inside JSON strings do not count. Null where no bracket is, or where the value never closes.
    """
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.regexp_extract(F.when(fenced != "", fenced).otherwise(c), r"(?s)([\[{].*)", 1)
    parts = F.regexp_extract_all(body, F.lit(r'(?s)("(?:[^"\\]|\\.)*"|[\[\]{}]|[^"\[\]{}]+|")'), 1)
    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("size"), F.lit(False).alias("done"))

    def step(acc, p):
        depth = acc["depth"] + F.when(p.isin("[", "{"), 1).when(p.isin("]", "}"), -1).otherwise(0)
        return F.when(acc["done"], acc).otherwise(F.struct(depth.alias("depth"), (acc["size"] + F.length(p)).alias("size"), (depth == 0).alias("done")))

    end = F.aggregate(parts, zero, step)
    return F.when(end["done"], F.substring(body, F.lit(1), end["size"]))


def filter_path(c: Column) -> Column:
    """A path with the signs escaped that a filter graph gives a meaning: backslash, colon and single quote."""
    for sign in ("\\", ":", "'"):
        c = F.replace(c, F.lit(sign), F.lit("\\" + sign))
    return c


def burn_style(height: Column, font: Column) -> Column:
    """Style of captions burned into a picture of a height; size and margin are rounded half to even."""
    size = F.greatest(F.lit(18), F.bround(height * F.lit(0.042)).cast("int"))
    margin = F.greatest(F.lit(20), F.bround(height * F.lit(0.04)).cast("int"))
    return F.format_string("FontName=%s,FontSize=%d,BorderStyle=1,Outline=2,Shadow=1,MarginV=%d", font, size, margin)


def keyword_union(first: Column, second: Column, most: int) -> Column:
    """The terms of both lists in order, each once, at most ``most``; null lists are empty."""
    none = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.concat(F.coalesce(first, none), F.coalesce(second, none))), 1, most)


def other_targets(files: Column, source: Column, target: Column) -> Column:
    """Sorted tags of the ``transcript.<tag>.srt`` files, burned ones left out, that are neither the run's languages nor ``auto``."""
    named = F.filter(files, lambda f: f.rlike(r"^transcript\..*\.srt$") & ~F.contains(f, F.lit(".burn.")))
    tags = F.transform(named, lambda f: F.substring(f, F.lit(12), F.length(f) - 15))
    return F.array_sort(F.array_except(tags, F.array(F.lower(source), F.lower(target), F.lit("auto"))))


#: Fixed value: characters of a recognition context, about 8,000 tokens.
CONTEXT_CHARS = 32_000


def recognition_context(terms: Column, text: Column, most: int = CONTEXT_CHARS) -> Column:
    """(terms, text) given to a recogniser, empty parts null; null if both are empty, an error if they are too long together."""
    kept = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: t != "")
    said = F.coalesce(strip(text), F.lit(""))
    size = F.length(F.array_join(kept, "")) + F.length(said)
    built = F.struct(F.when(F.size(kept) > 0, kept).alias("terms"), F.nullif(said, F.lit("")).alias("text"))
    return F.when(size > most, F.raise_error(F.lit(f"recognition context over {most} characters")).cast("struct<terms:array<string>,text:string>")).when(size > 0, built)


def inline_part(data: Column, most: int) -> Column:
    """Bytes as base64 for a request; null for what is larger than ``most`` bytes and has to be sent another way."""
    return F.when(F.octet_length(data) <= most, F.base64(data))


def sidecar_name(stem: Column, tag: Column) -> Column:
    """``<stem>.<tag>.srt``, where the stem loses the same tag at its end."""
    cut = F.when(F.endswith(stem, F.concat(F.lit("."), tag)), F.substring(stem, F.lit(1), F.length(stem) - F.length(tag) - 1)).otherwise(stem)
    return F.concat(cut, F.lit("."), tag, F.lit(".srt"))


def tempo_chain(factor: Column) -> Column:
    """Factors within [0.5, 2] whose product is ``factor``: as many twos or halves as needed, then the rest. Null if not above 0."""
    up = F.greatest(F.lit(0), F.ceil(F.log2(factor) - F.lit(1) - F.lit(1e-12))).cast("int")
    down = F.greatest(F.lit(0), F.ceil(-F.log2(factor) - F.lit(1) - F.lit(1e-12))).cast("int")
    last = factor / F.pow(F.lit(2.0), up) * F.pow(F.lit(2.0), down)
    chain = F.concat(F.array_repeat(F.lit(2.0), up), F.array_repeat(F.lit(0.5), down), F.array(last))
    return F.when(factor > 0, chain)


def backoff_s(attempt: Column, base: float = 1.0, most: float = 30.0) -> Column:
    """Seconds before the next attempt, without jitter."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt))


def amplitude(decibels: Column) -> Column:
    return F.pow(F.lit(10.0), decibels / 20)


def error_class(status: Column, name: Column, retries_rate_limits: Column) -> Column:
    """``infra`` for server errors, timeouts and lost connections (429 only where the client retries rate limits), else ``content``."""
    limited = (status == 429) & retries_rate_limits
    return (
        F.when(status.isNotNull(), F.when((status >= 500) | limited, "infra").otherwise("content"))
        .when(F.contains(name, F.lit("Timeout")) | F.contains(name, F.lit("Connection")), "infra")
        .otherwise("content")
    )


def error_code(status: Column, name: Column) -> Column:
    return (
        F.when(status.isNotNull(), F.concat(F.lit("http_"), status.cast("string")))
        .when(F.contains(name, F.lit("Timeout")), "timeout")
        .when(F.contains(name, F.lit("Connection")), "connection")
        .otherwise(name)
    )


def fingerprint(**fields: Column) -> Column:
    """sha256 of the compact JSON of the fields in alphabetical order; nulls are kept."""
    body = F.struct(*[c.alias(n) for n, c in sorted(fields.items())])
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def content_words(words: Column) -> Column:
    """Words that are not stopwords, once each."""
    return F.array_except(words, F.array(*map(F.lit, STOPWORDS)))
