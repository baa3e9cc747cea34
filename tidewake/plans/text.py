"""Queries over the texts of messages: features, templates, redaction. A document's first line is its subject."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import html
from tidewake.functions import text as tx
from tidewake.operators import frame as fr
from tidewake.operators import redaction as red
from tidewake.plans import messages
from tidewake.sources.scratch import written
from tidewake.sources.tables import load, spread

SUBJECT = F.substring_index


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    d = spread(load(spark, sf, "documents").select("doc_id", "source", "lang", "text"))
    return d.select("doc_id", "source", "lang", "text", F.substring_index("text", "\n", 1).alias("subject"))


def text_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf).select(
        "doc_id", tx.n_words(t).alias("n_words"), tx.n_sentences(t).alias("n_sentences"), tx.n_paragraphs(t).alias("n_paragraphs"),
        F.size(tx.questions(t)).alias("n_questions"), tx.n_links(t).alias("n_links"), tx.n_bullets(t).alias("n_bullets"),
    )


def subject_features(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("subject")
    return _docs(spark, sf).select("doc_id", F.length(s).alias("chars"), tx.n_tokens(s).alias("words"), F.endswith(F.trim(s), F.lit("?")).alias("is_question"))


def _hashed(spark: SparkSession, sf: str) -> DataFrame:
    t = tx.template_text(F.col("text"))
    return _docs(spark, sf).select("doc_id", "source", F.md5(t).alias("hash"), F.length(t).alias("hash_length"))


def template_repeats(spark: SparkSession, sf: str) -> DataFrame:
    hashed = written(_hashed(spark, sf), "hashed")  # used twice, and a join asks for its key once more: texts are hashed once
    counts = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("repeats"))  # then a join, of which Spark can split a hot hash
    out = hashed.join(counts, "hash")
    return out.select("doc_id", "hash", "hash_length", "repeats", ((F.col("repeats") >= 3) & (F.col("hash_length") >= 40)).alias("is_template"))


def template_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Templates by how many sources send them: many copies from few, one from each, or between."""
    per = _hashed(spark, sf).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources")).where("n >= 2")
    ratio = F.col("sources") / F.col("n")
    kind = F.when(ratio <= 0.34, "many from few").when(ratio >= 0.9, "one from each").otherwise("mixed")
    return per.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("templates"), F.sum("n").alias("documents"), F.round(F.avg(ratio), 6).alias("mean_ratio"))


def name_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the text's first plain word of three letters occurs again after the first line."""
    d = _docs(spark, sf).withColumn("name", tx.norm_name(F.regexp_extract("text", r"[A-Za-z]{3,}", 0)))
    body = F.substring(F.col("text"), F.length("subject") + 1, F.length("text"))
    return d.select("doc_id", "name", tx.mentions(body, F.col("name")).alias("again"), tx.mentions(F.col("subject"), F.col("name")).alias("in_subject"))


def subject_norm_match(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a document's subject ties it to that of the one before in its source."""
    from tidewake.operators.attribution import subjects_match

    d = _docs(spark, sf).withColumn("norm", tx.norm_subject(F.concat(F.lit("Re: [x] FW: "), F.col("subject"))))
    return fr.with_previous(d.select("doc_id", "norm", "source"), "source", "doc_id", "norm", "before").select(
        "doc_id", "norm", subjects_match(F.col("norm"), F.array(F.coalesce("before", F.lit("")))).alias("tied")
    )


def dedup_subjects(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).groupBy(tx.dedup_subject(F.col("subject")).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Long tokens of the benchmark items."""
    items = load(spark, sf, "benchmark")
    return red.tokens(items.withColumnRenamed("item_id", "id"), "id", "text").where("length(token) >= 9").select("token").distinct()


def leak_scan(spark: SparkSession, sf: str) -> DataFrame:
    return red.leaked(_docs(spark, sf), "doc_id", "text", vocabulary(spark, sf))


def vocab_pruning(spark: SparkSession, sf: str) -> DataFrame:
    return red.pruned(_docs(spark, sf), "doc_id", "text", vocabulary(spark, sf))


WORDS = ["the", "de", "der"]


def _redacted(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", tx.redacted(F.col("text"), vocabulary=WORDS).alias("shown"))


def redacted_docs(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("shown")  # a vocabulary of several words, longest first, is in the tests; here it is single words, as in SQL
    count = lambda name: F.regexp_count(s, F.lit(rf"\[{name}\]"))
    return _redacted(spark, sf).select("doc_id", count("EMAIL").alias("emails"), count("LINK").alias("links"), count("YEAR").alias("years"), count("DATE").alias("dates"), F.md5(s).alias("text"))


def redacted_by_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Texts without identifiers and without the terms of a vocabulary table, whatever its size."""
    d = _docs(spark, sf).select("doc_id", "text")
    shown = red.redacted_by(d, "doc_id", "text", vocabulary(spark, sf))
    return shown.select("doc_id", F.regexp_count("text", F.lit(r"\[SENDER\]")).alias("marks"), F.md5("text").alias("text"))


def over_redaction(spark: SparkSession, sf: str) -> DataFrame:
    shown = _docs(spark, sf).select("doc_id", F.regexp_replace("text", "[A-Za-z]+e ", "[SENDER] ").alias("shown"))
    return red.over_redaction(shown, "doc_id", "shown").withColumn("share", F.round("share", 6))


def ratable(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by whether enough words are left to rate once vocabulary is gone."""
    n = tx.ratable_words(F.col("shown"))
    return _redacted(spark, sf).groupBy((n >= 8).alias("ratable")).agg(F.count(F.lit(1)).alias("n"))


def html_text(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", tx.tidied(html.text_of(F.col("html"))).alias("text"))


def html_formatting_counts(spark: SparkSession, sf: str) -> DataFrame:
    pages = load(spark, sf, "pages").select("page_id", tx.rendered(F.col("html")).alias("r"))
    return pages.select("page_id", tx.formatting_within(F.col("r"), F.length("r.text")).alias("f")).select("page_id", "f.*")


def strip_quoted(spark: SparkSession, sf: str) -> DataFrame:
    own = tx.without_quotes(F.concat("text", F.lit("\n> quoted\nOn Monday someone\nwrote:\nold")))
    return _docs(spark, sf).select("doc_id", F.md5(own).alias("own"), F.length(own).alias("n_chars"))


def signature_split(spark: SparkSession, sf: str) -> DataFrame:
    signed = F.concat("text", F.lit("\nBest regards,\nSomeone\nPhone: 1"))
    return _docs(spark, sf).select("doc_id", tx.signature(signed).alias("s")).select("doc_id", F.md5("s.body").alias("body"), F.md5("s.signature").alias("signature"))


def unwrapped_text(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.md5(tx.unwrapped(F.col("text"))).alias("unwrapped"))


NAMES = (
    "text_counts subject_features template_repeats template_kinds name_mentions subject_norm_match dedup_subjects leak_scan vocab_pruning "
    "redacted_docs redacted_by_vocabulary over_redaction ratable html_text html_formatting_counts strip_quoted signature_split unwrapped_text"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

_D = "WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10))[1] AS subject FROM documents)"
_TEMPLATE = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://[^\\s<>\\)\\]]+', ' ', 'g'),
    '[a-z0-9._%+\\-'']+@[a-z0-9.\\-]+', ' ', 'g'), '\\d+', ' ', 'g'), '[^a-z ]', ' ', 'g'), '\\s+', ' ', 'g'))"""
_HASHED = _D + f", h AS (SELECT doc_id, source, md5({_TEMPLATE}) AS hash, CAST(length({_TEMPLATE}) AS INTEGER) AS hash_length FROM d)"
_TOKENS = """tok AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS t FROM documents) WHERE t <> ''),
    words AS (SELECT doc_id, lower(t) AS token, max(CASE WHEN t = lower(t) THEN 1 ELSE 0 END) AS low FROM tok GROUP BY 1, 2),
    vocab AS (SELECT DISTINCT lower(t) AS token FROM (SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS t FROM benchmark) WHERE length(t) >= 9)"""
_NOT_WORD = "[^\\p{L}\\p{N}_]"

SQL = {
    "text_counts": _D
    + """ SELECT doc_id, CAST(len(regexp_extract_all(text, '[A-Za-z0-9''\\-\\[\\]]+')) AS INTEGER) AS n_words,
          CAST(len(list_filter(regexp_split_to_array(text, '(?:[.!?]+\\s+|\\n+)'), lambda x: len(regexp_extract_all(x, '\\S+')) >= 3)) AS INTEGER) AS n_sentences,
          CAST(len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: len(regexp_extract_all(x, '\\S+')) >= 4)) AS INTEGER) AS n_paragraphs,
          CAST(len(list_filter(regexp_split_to_array(regexp_replace(text, '([.!?])\\s', '\\1' || chr(10), 'g'), chr(10)), lambda x: suffix(trim(x), '?') AND length(trim(x)) > 2)) AS INTEGER) AS n_questions,
          CAST(len(regexp_extract_all(text, '(?i)https?://[^\\s<>\\)\\]]+')) AS INTEGER) AS n_links,
          CAST(len(regexp_extract_all(text, '(?m)^\\s*[•\\-\\*]\\s+\\S')) AS INTEGER) AS n_bullets FROM d""",
    "subject_features": _D
    + " SELECT doc_id, CAST(length(subject) AS INTEGER) AS chars, CAST(len(regexp_extract_all(subject, '\\S+')) AS INTEGER) AS words, suffix(trim(subject), '?') AS is_question FROM d",
    "template_repeats": _HASHED
    + " SELECT doc_id, hash, hash_length, count(*) OVER (PARTITION BY hash) AS repeats, count(*) OVER (PARTITION BY hash) >= 3 AND hash_length >= 40 AS is_template FROM h",
    "template_kinds": _HASHED
    + """, per AS (SELECT hash, count(*) AS n, count(DISTINCT source) / count(*) AS ratio FROM h GROUP BY 1 HAVING count(*) >= 2)
          SELECT CASE WHEN ratio <= 0.34 THEN 'many from few' WHEN ratio >= 0.9 THEN 'one from each' ELSE 'mixed' END AS kind,
                 count(*) AS templates, CAST(sum(n) AS BIGINT) AS documents, round(avg(ratio), 6) AS mean_ratio FROM per GROUP BY 1""",
    "name_mentions": _D
    + f""", n AS (SELECT *, lower(regexp_extract(text, '[A-Za-z]{{3,}}')) AS name FROM d)
          SELECT doc_id, name, name <> '' AND regexp_matches(lower(substring(text, length(subject) + 1)), '(^|{_NOT_WORD})' || name || '($|{_NOT_WORD})') AS again,
                 name <> '' AND regexp_matches(lower(subject), '(^|{_NOT_WORD})' || name || '($|{_NOT_WORD})') AS in_subject FROM n""",
    "subject_norm_match": _D
    + """, n AS (SELECT doc_id, source, trim(regexp_replace(lower(subject), '[^a-z0-9]+', ' ', 'g')) AS norm FROM d),
          b AS (SELECT *, coalesce(lag(norm) OVER (PARTITION BY source ORDER BY doc_id), '') AS before FROM n)
          SELECT doc_id, norm, norm <> '' AND before <> '' AND (norm = before OR (least(length(norm), length(before)) >= 6 AND (contains(norm, before) OR contains(before, norm)))) AS tied FROM b""",
    "dedup_subjects": _D
    + """ SELECT substring(trim(regexp_replace(regexp_replace(lower(subject), '^(re|fwd?|aw)\\s*:\\s*', ''), '\\s+', ' ', 'g')), 1, 60) AS key, count(*) AS n, min(doc_id) AS first_id
          FROM d GROUP BY 1""",
    "leak_scan": "WITH " + _TOKENS + " SELECT token, count(*) AS n_docs FROM words JOIN vocab USING (token) GROUP BY 1",
    "vocab_pruning": "WITH "
    + _TOKENS
    + """, seen AS (SELECT token, CAST(sum(low) AS BIGINT) AS n_lower, count(*) AS n_any FROM words GROUP BY 1)
          SELECT token, coalesce(n_lower, 0) AS n_lower, coalesce(n_any, 0) AS n_any, coalesce(n_lower >= 3 AND n_lower / n_any >= 0.2, false) AS ordinary
          FROM vocab LEFT JOIN seen USING (token)""",
    "redacted_docs": messages._M
    + ","
    + messages._redaction("text", False)
    + """ SELECT doc_id, CAST(len(regexp_extract_all(t, '\\[EMAIL\\]')) AS INTEGER) AS emails, CAST(len(regexp_extract_all(t, '\\[LINK\\]')) AS INTEGER) AS links,
               CAST(len(regexp_extract_all(t, '\\[YEAR\\]')) AS INTEGER) AS years, CAST(len(regexp_extract_all(t, '\\[DATE\\]')) AS INTEGER) AS dates, md5(t) AS text FROM z""",
    "redacted_by_vocabulary": messages._M
    + ","
    + messages._redaction("text", False)
    + ","
    + _TOKENS
    + """, known AS (SELECT list(token) AS tokens FROM vocab),
          p AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(t, '[\\p{L}\\p{M}\\p{N}_]+|[^\\p{L}\\p{M}\\p{N}_]+'),
                   lambda x: CASE WHEN length(x) >= 9 AND list_contains(tokens, lower(x)) THEN '[SENDER]' ELSE x END), '') AS t FROM r8, known),
          """
    + f"""q AS (SELECT doc_id, {messages._strip("regexp_replace(t, '(\\[SENDER\\][\\s,|]*){2,}', '[SENDER] ', 'g')")} AS t FROM p)
          SELECT doc_id, CAST(len(regexp_extract_all(t, '\\[SENDER\\]')) AS INTEGER) AS marks, md5(t) AS text FROM q""",
    "ratable": messages._M
    + ","
    + messages._redaction("text", False)
    + """ SELECT len(regexp_extract_all(regexp_replace(t, '\\[(NAME|COMPANY|LINK|EMAIL|DATE|YEAR|SENDER)\\]', ' ', 'g'), '[A-Za-z]{2,}')) >= 8 AS ratable, count(*) AS n FROM z GROUP BY 1""",
    "strip_quoted": messages._M
    + ","
    + messages.unquoted_sql("text || chr(10) || '> quoted' || chr(10) || 'On Monday someone' || chr(10) || 'wrote:' || chr(10) || 'old'")
    + " SELECT doc_id, md5(q) AS own, CAST(length(q) AS INTEGER) AS n_chars FROM q",
    "signature_split": messages._M
    + ", f AS (SELECT doc_id, text || chr(10) || 'Best regards,' || chr(10) || 'Someone' || chr(10) || 'Phone: 1' AS t FROM m),"
    + messages.signed_sql("t", "f")
    + " SELECT doc_id, md5(body) AS body, md5(signature) AS signature FROM g",
    "html_text": f"SELECT page_id, {messages.tidied_sql(messages.page_sql('html'))} AS text FROM pages",
    "unwrapped_text": f"SELECT doc_id, md5({messages.unwrapped_sql('text')}) AS unwrapped FROM documents",
    "over_redaction": """WITH s AS (SELECT doc_id, regexp_replace(text, '[A-Za-z]+e ', '[SENDER] ', 'g') AS t FROM documents),
        n AS (SELECT doc_id, CAST(len(regexp_extract_all(t, '\\[(NAME|COMPANY|LINK|EMAIL|DATE|YEAR|SENDER)\\]')) AS INTEGER) AS placeholders,
                     CAST(len(regexp_extract_all(t, '\\S+')) AS INTEGER) AS tokens FROM s)
        SELECT doc_id, placeholders, tokens, round(placeholders / nullif(tokens, 0), 6) AS share, coalesce(placeholders / nullif(tokens, 0) > 0.15, false) AS too_many FROM n""",
}
