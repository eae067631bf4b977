"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..tables import table
from . import base as B

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_WS = r"list_filter(string_split_regex({0}, '\s+'), lambda t: t <> '')"
_NORM = r"list_filter(string_split_regex(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s'']', ' ', 'g'), '\s+'), lambda t: t <> '')"
_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def _joined(c):
    return F.md5(F.concat_ws(" ", c).cast("binary"))


def normalized_words(spark: SparkSession, d: str) -> DataFrame:
    n = T.normalize(F.col("text"))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(n).alias("n_words"), _joined(n).alias("digest"))


def word_tokens(spark: SparkSession, d: str) -> DataFrame:
    n = T.tokens(F.col("text"))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.size(n).alias("n_tokens"), _joined(n).alias("digest"))


def sentence_clauses(spark: SparkSession, d: str) -> DataFrame:
    s, c = T.sentences(F.col("text")), T.clauses(F.col("text"))
    return table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", F.size(s).alias("n_sentences"), F.size(c).alias("n_clauses"), F.md5(F.concat_ws("|", s).cast("binary")).alias("digest"))


def length_units(spark: SparkSession, d: str) -> DataFrame:
    s = B.segments(spark, d, "text_target")
    return s.where("text_target is not null").select("run_id", "idx", T.syllables(F.col("text_target")).alias("n_syllables"), T.chars(F.col("text_target")).alias("n_chars"))


def skippable_words(spark: SparkSession, d: str) -> DataFrame:
    s = B.segments(spark, d, "text_src")
    w = s.select("run_id", "idx", F.explode(F.split("text_src", " ")).alias("t"))
    return w.groupBy("run_id").agg(F.count_if(T.skippable(F.col("t"))).alias("n_skipped"), F.count(F.lit(1)).alias("n_tokens"))


def clock_times(spark: SparkSession, d: str) -> DataFrame:
    c = B.cues(spark, d).where("start_ms is not null")
    line = T.clock(F.col("start_ms"))
    return c.select("run_id", "cue_idx", line.alias("start_clock"), T.parse_clock(line).alias("back_ms"))


def language_tags(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "runs", "run_id", "source_lang", "target_lang")
    s, t = T.base_tag(F.col("source_lang")), T.base_tag(F.col("target_lang"))
    return r.select("run_id", s.alias("source_tag"), t.alias("target_tag"), (s == t).alias("same_language"))


def mined_keywords(spark: SparkSession, d: str, most: int = 32) -> DataFrame:
    """Terms of a run's cues: acronyms and capitalised words inside sentences, and any capitalised word seen twice; the commonest ``most``."""
    c = B.cues(spark, d).where("text is not null").select("run_id", "text")
    sentences = c.select("run_id", F.explode(F.split("text", "[.!?]+")).alias("s"))
    tokens = sentences.select("run_id", F.posexplode(F.regexp_extract_all("s", F.lit(r"([A-Za-z][A-Za-z0-9'/+.\-]*)"), 1)).alias("j", "term"))
    stop = F.lower("term").isin(T.STOPWORDS)
    acronym = (F.length("term") >= 2) & F.col("term").rlike("[A-Z]") & (F.upper("term") == F.col("term"))
    proper = (F.col("j") > 0) & F.col("term").rlike("^[A-Z]") & (F.length("term") >= 3)
    one = tokens.where((acronym | proper) & ~stop).groupBy("run_id", "term").agg(F.count(F.lit(1)).alias("n"))
    capital = c.select("run_id", F.explode(F.regexp_extract_all("text", F.lit(r"([A-Za-z0-9_][A-Za-z0-9_'/+.\-]*[A-Za-z0-9_]|[A-Za-z0-9_])"), 1)).alias("term"))
    two = capital.where(F.col("term").rlike(r"^[A-Z][A-Za-z0-9'/+.\-]{2,}$") & ~stop).groupBy("run_id", "term").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    both = one.unionByName(two).groupBy("run_id", "term").agg(F.max("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("n"), "term"))
    return both.withColumn("rank", rank).where(F.col("rank") <= most)


_MINED = r"""
sent AS (SELECT run_id, unnest(string_split_regex(text, '[.!?]+')) AS s FROM c WHERE text IS NOT NULL),
lists AS (SELECT run_id, regexp_extract_all(s, '[A-Za-z][A-Za-z0-9''/+.\-]*') AS l FROM sent),
tok AS (SELECT run_id, unnest(l) AS term, unnest(range(len(l))) AS j FROM lists),
one AS (SELECT run_id, term, count(*) AS n FROM tok WHERE ((length(term) >= 2 AND regexp_matches(term, '[A-Z]') AND upper(term) = term) OR (j > 0 AND regexp_matches(term, '^[A-Z]') AND length(term) >= 3)) AND NOT list_contains({stop}, lower(term)) GROUP BY ALL),
caps AS (SELECT run_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_][A-Za-z0-9_''/+.\-]*[A-Za-z0-9_]|[A-Za-z0-9_]')) AS term FROM c WHERE text IS NOT NULL),
two AS (SELECT run_id, term, count(*) AS n FROM caps WHERE regexp_matches(term, '^[A-Z][A-Za-z0-9''/+.\-]{{2,}}$') AND NOT list_contains({stop}, lower(term)) GROUP BY ALL HAVING count(*) >= 2),
both_ AS (SELECT run_id, term, max(n) AS n FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL)
""".format(stop=_STOP)


def content_difference(spark: SparkSession, d: str) -> DataFrame:
    """Content words that either side of a segment has, its words of no content left out."""
    s = B.segments(spark, d, "text_src", "text_target").where("text_src is not null and text_target is not null")
    words = F.array_sort(T.content_words(F.array_union(T.normalize(F.col("text_src")), T.normalize(F.col("text_target")))))
    return s.select("run_id", "idx", F.size(words).alias("n_words"), _joined(words).alias("digest"))


def tempo_chains(spark: SparkSession, d: str) -> DataFrame:
    """Tempo factors that bring a line's reading time into its slot."""
    s = B.timed(B.segments(spark, d, "text_target")).where("text_target is not null")
    factor = T.chars(F.col("text_target")) / F.lit(15.0) / ((F.col("end_ms") - F.col("start_ms")) / F.lit(1000.0))
    chain = T.tempo_chain(factor)
    return s.select("run_id", "idx", F.size(chain).alias("n_steps"), F.round(F.element_at(chain, -1), 6).alias("last_step"))


def retry_errors(spark: SparkSession, d: str) -> DataFrame:
    """Class, code and backoff of synthetic failures: the events of type error, their value as status."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value").where(F.col("value").isNotNull())
    status = F.when(F.col("event_id") % 3 == 0, (F.lit(400) + F.floor(F.abs("value")) % 200).cast("int"))
    name = F.when(F.col("event_id") % 5 == 0, "ReadTimeout").when(F.col("event_id") % 5 == 1, "ConnectionError").otherwise("ValueError")
    limited = F.col("event_id") % 2 == 0
    attempt = F.col("event_id") % 7
    return e.select("event_id", T.error_class(status, name, limited).alias("error_class"), T.error_code(status, name).alias("error_code"), T.backoff_s(attempt).alias("backoff_s"))


def line_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """Content key of a line: text and length budget."""
    s = B.timed(B.segments(spark, d, "text_target")).where(F.col("text_target").isNotNull())
    budget = F.greatest(F.lit(3), F.floor((F.col("end_ms") - F.col("start_ms")) * F.lit(0.015))).cast("bigint")
    return s.select("run_id", "idx", T.fingerprint(budget=budget, text=F.col("text_target")).alias("fingerprint"))


def parsed_replies(spark: SparkSession, d: str) -> DataFrame:
    """Settings, keyword lines and JSON in reply texts, over replies made from the event properties."""
    e = table(spark, d, "events", "event_id", "event_type", "user_id", "props").where("props is not null")
    voices = F.concat(F.lit("A="), F.col("event_type"), F.lit(", broken ,=x,B= "), F.col("user_id").cast("string"), F.lit(" ,C="))
    reply = F.concat(F.lit("Sure.\n```json\n"), F.col("props"), F.lit("\n```\nKEYWORDS: "), F.col("event_type"), F.lit("; ;CI/CD;  API \nKEYWORDS: later"))
    m = T.pair_list(voices)
    return e.select(
        "event_id", F.size(m).alias("n_voices"), m["A"].alias("voice_a"), m["B"].alias("voice_b"), F.concat_ws("|", T.comma_list(voices)).alias("parts"),
        F.concat_ws("|", T.keyword_line(reply)).alias("keywords"), (T.embedded_json(reply) == F.col("props")).alias("json_found"),
        T.keyword_prompt(T.keyword_line(reply), "Transcribe.", 2).alias("prompt"), F.contains(T.without_keyword_line(reply), F.lit("KEYWORDS: later")).alias("later_kept"),
    )


QUERIES = {
    "normalized_words": normalized_words, "word_tokens": word_tokens, "sentence_clauses": sentence_clauses, "length_units": length_units, "skippable_words": skippable_words,
    "clock_times": clock_times, "language_tags": language_tags, "mined_keywords": mined_keywords, "content_difference": content_difference, "tempo_chains": tempo_chains,
    "retry_errors": retry_errors, "line_fingerprints": line_fingerprints, "parsed_replies": parsed_replies,
}

_DIGITS = "length(regexp_replace(t, '[^0-9]', '', 'g'))"
ORACLES = {
    "normalized_words": f"SELECT doc_id, len(n) AS n_words, md5(array_to_string(n, ' ')) AS digest FROM (SELECT doc_id, {_NORM.format('text')} AS n FROM documents)",
    "word_tokens": r"SELECT doc_id, len(n) AS n_tokens, md5(array_to_string(n, ' ')) AS digest FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_'']+') AS n FROM documents)",
    "sentence_clauses": "WITH t AS (SELECT doc_id, " + _STRIP.format("text") + r""" AS x FROM documents),
p AS (SELECT doc_id, list_filter(string_split(regexp_replace(x, '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda t: t <> '') AS s, list_filter(string_split(regexp_replace(x, '([,;:])\s+', '\1' || chr(1), 'g'), chr(1)), lambda t: t <> '') AS c FROM t)
SELECT doc_id, len(s) AS n_sentences, len(c) AS n_clauses, md5(array_to_string(s, '|')) AS digest FROM p""",
    "length_units": B.sql(B.S, f"""SELECT run_id, idx, greatest(1, coalesce(list_sum(list_transform({_WS.format('text_target')}, lambda t: CASE WHEN {_DIGITS} > 0 THEN greatest(1, CAST(round_even({_DIGITS} * 1.5, 0) AS BIGINT)) ELSE 1 END)), 0)) AS n_syllables,
greatest(1, length({_STRIP.format('text_target')})) AS n_chars FROM s WHERE text_target IS NOT NULL"""),
    "skippable_words": B.sql(B.S, "t AS (SELECT run_id, unnest(string_split(text_src, ' ')) AS t FROM s)", "x AS (SELECT run_id, " + _STRIP.format("t") + " AS t FROM t)", "SELECT run_id, count(*) FILTER (WHERE t = '' OR regexp_full_match(t, '<.*>')) AS n_skipped, count(*) AS n_tokens FROM x GROUP BY run_id"),
    "clock_times": B.sql(B.C, "SELECT run_id, cue_idx, printf('%02d:%02d:%02d,%03d', g // 3600000, (g % 3600000) // 60000, (g % 60000) // 1000, g % 1000) AS start_clock, g AS back_ms FROM (SELECT run_id, cue_idx, greatest(start_ms, 0) AS g FROM c WHERE start_ms IS NOT NULL)"),
    "language_tags": "SELECT run_id, lower(trim(split_part(source_lang, '-', 1))) AS source_tag, lower(trim(split_part(target_lang, '-', 1))) AS target_tag, lower(trim(split_part(source_lang, '-', 1))) = lower(trim(split_part(target_lang, '-', 1))) AS same_language FROM runs",
    "mined_keywords": B.sql(B.C, _MINED.strip(), "SELECT run_id, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY n DESC, term) AS rank FROM both_) WHERE rank <= 32"),
    "content_difference": B.sql(B.S, f"x AS (SELECT run_id, idx, list_sort(list_filter(list_distinct(list_concat({_NORM.format('text_src')}, {_NORM.format('text_target')})), lambda t: NOT list_contains({_STOP}, t))) AS l FROM s WHERE text_src IS NOT NULL AND text_target IS NOT NULL)", "SELECT run_id, idx, len(l) AS n_words, md5(array_to_string(l, ' ')) AS digest FROM x"),
    "tempo_chains": B.sql(B.S, f"f AS (SELECT run_id, idx, greatest(1, length({_STRIP.format('text_target')})) / 15.0 / ((end_ms - start_ms) / 1000.0) AS f FROM s WHERE end_ms > start_ms AND text_target IS NOT NULL)",
        "k AS (SELECT *, CAST(greatest(0, ceil(log2(f) - 1 - 1e-12)) AS INT) AS up, CAST(greatest(0, ceil(-log2(f) - 1 - 1e-12)) AS INT) AS down FROM f)",
        "SELECT run_id, idx, up + down + 1 AS n_steps, round(f / pow(2.0, up) * pow(2.0, down), 6) AS last_step FROM k"),
    "retry_errors": """WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(400 + CAST(floor(abs(value)) AS BIGINT) % 200 AS INT) END AS status,
CASE WHEN event_id % 5 = 0 THEN 'ReadTimeout' WHEN event_id % 5 = 1 THEN 'ConnectionError' ELSE 'ValueError' END AS name, event_id % 2 = 0 AS lim FROM events WHERE value IS NOT NULL)
SELECT event_id, CASE WHEN status IS NOT NULL THEN CASE WHEN status >= 500 OR (status = 429 AND lim) THEN 'infra' ELSE 'content' END WHEN name IN ('ReadTimeout', 'ConnectionError') THEN 'infra' ELSE 'content' END AS error_class,
CASE WHEN status IS NOT NULL THEN 'http_' || status WHEN name = 'ReadTimeout' THEN 'timeout' WHEN name = 'ConnectionError' THEN 'connection' ELSE name END AS error_code, least(30.0, pow(2.0, event_id % 7)) AS backoff_s FROM e""",
    "line_fingerprints": B.sql(B.S, """SELECT run_id, idx, sha256('{"budget":' || CAST(greatest(3, floor((end_ms - start_ms) * 0.015)) AS BIGINT) || ',"text":' || CAST(to_json(text_target) AS VARCHAR) || '}') AS fingerprint FROM s WHERE end_ms > start_ms AND text_target IS NOT NULL"""),
    "parsed_replies": "SELECT event_id, 2 AS n_voices, event_type AS voice_a, CAST(user_id AS VARCHAR) AS voice_b, 'A=' || event_type || '|broken|=x|B= ' || user_id || '|C=' AS parts, event_type || '|CI/CD|API' AS keywords, true AS json_found, 'Transcribe. Keywords: ' || event_type || ', CI/CD' AS prompt, true AS later_kept FROM events WHERE props IS NOT NULL",
}
