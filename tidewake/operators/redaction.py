"""Redaction by a vocabulary table, leak scans, over-redaction and vocabulary pruning: texts are tokenised and joined to
the vocabulary, which may have any number of terms."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions import text as tx
from tidewake.sources.scratch import written

SENDER = "[SENDER]"


def _pieces(c: Column) -> Column:
    """A text as its words and what stands between them, in order: joined, they are the text again."""
    return F.regexp_extract_all(c, F.lit(r"(?U)(\w+|\W+)"), 0)


def _lowered(pieces: Column) -> Column:
    return F.transform(pieces, F.lower)


def terms_of(vocabulary: DataFrame, term: str) -> DataFrame:
    """first and pieces of each term, in lower case. A term begins and ends with a word; others never stand between word
    boundaries."""
    found = vocabulary.select(_lowered(_pieces(F.col(term))).alias("pieces")).where("size(pieces) > 0").distinct()
    word = lambda k: F.rlike(F.element_at("pieces", k), F.lit(r"(?U)^\w"))
    return found.where(word(1) & word(-1)).select(F.element_at("pieces", 1).alias("first"), "pieces")


def _rebuilt(batches: Iterator[pa.RecordBatch], text: str, mark: str) -> Iterator[pa.RecordBatch]:
    """Rows with a mark for each term in their text: from left to right, at each word the longest term that begins there.
    Rows without terms stay as they are."""
    for batch in batches:
        names = batch.schema.names[:-3]
        texts = []
        for kept, own, low, terms in zip(*(batch.column(c).to_pylist() for c in (text, "_own", "_low", "_terms")), strict=True):
            if terms is None:
                texts.append(kept)
                continue
            known: dict[str, dict[int, set[tuple[str, ...]]]] = {}
            for t in terms:
                known.setdefault(t[0], {}).setdefault(len(t), set()).add(tuple(t))
            sizes = {first: sorted(by_size, reverse=True) for first, by_size in known.items()}
            out, k = [], 0
            while k < len(own):
                n = next((n for n in sizes.get(low[k], ()) if tuple(low[k : k + n]) in known[low[k]][n]), 0)
                out.append(mark if n else own[k])
                k += n or 1
            texts.append("".join(out))
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else batch.column(c) for c in names], names)


def by_vocabulary(docs: DataFrame, key: str, text: str, vocabulary: DataFrame, term: str = "token", mark: str = SENDER) -> DataFrame:
    """``docs`` (one row for each ``key``) with a mark in place of each term of the vocabulary, in whatever case, that
    stands between word boundaries; of terms that begin at one word the longest.

    The distinct words of each text meet the first words of the terms in a join, of which Spark broadcasts the smaller side
    only if it is small. A text gets only its own candidates back, in one join, and only texts with some are cut into pieces
    and rebuilt. Null texts stay. ``docs`` is read twice."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"(?U)\w+"), 0)  # a term begins with a word
    words = docs.select(F.col(key).alias("_key"), F.explode(F.array_distinct(_lowered(found))).alias("first"))
    hits = words.join(terms_of(vocabulary, term), "first").groupBy("_key").agg(F.collect_list("pieces").alias("_terms"))
    met = docs.join(hits, F.col(key) == F.col("_key"), "left")
    own = F.when(F.col("_terms").isNotNull(), _pieces(F.col(text)))
    cut = met.select(*docs.columns, own.alias("_own"), _lowered(own).alias("_low"), "_terms")
    return cut.mapInArrow(partial(_rebuilt, text=text, mark=mark), docs.schema)


def redacted_by(
    docs: DataFrame, key: str, text: str, vocabulary: DataFrame, term: str = "token",
    first: Column | None = None, company: Column | None = None, domains: list[str] = (),
) -> DataFrame:
    """What ``text.redacted`` does, with the vocabulary as a table."""
    rows = written(docs.withColumn(text, tx.without_identifiers(F.col(text), first, company, domains)), "redacted")  # used twice
    return by_vocabulary(rows, key, text, vocabulary, term).withColumn(text, tx.stripped(tx.senders_joined(F.col(text))))


def tokens(docs: DataFrame, key: str, text: str, pattern: str = "[^A-Za-z]+") -> DataFrame:
    """Distinct tokens of each document: token (lower case) and whether it occurs in lower case."""
    parts = docs.select(key, F.explode(F.array_distinct(F.split(text, pattern, -1))).alias("_t")).where("_t != ''")
    return parts.groupBy(key, F.lower("_t").alias("token")).agg(F.max((F.col("_t") == F.lower("_t")).cast("int")).alias("lower"))


def leaked(docs: DataFrame, key: str, text: str, vocabulary: DataFrame) -> DataFrame:
    """Documents that each vocabulary token stands in; the whole vocabulary, not the pruned one."""
    return tokens(docs, key, text).join(vocabulary.select("token").distinct(), "token").groupBy("token").agg(F.count(F.lit(1)).alias("n_docs"))


def pruned(docs: DataFrame, key: str, text: str, vocabulary: DataFrame, least: int = 3, share: float = 0.2) -> DataFrame:
    """Tokens with the evidence of their case: ordinary words occur in lower case in enough documents."""
    found = tokens(docs, key, text).groupBy("token").agg(F.sum("lower").alias("n_lower"), F.count(F.lit(1)).alias("n_any"))
    out = vocabulary.select("token").distinct().join(found, "token", "left").fillna(0)
    ordinary = (F.col("n_lower") >= least) & (F.col("n_any") > 0) & (F.col("n_lower") / F.col("n_any") >= share)
    return out.withColumn("ordinary", F.coalesce(ordinary, F.lit(False)))


def over_redaction(docs: DataFrame, key: str, text: str, most: float = 0.15) -> DataFrame:
    """Placeholders, tokens and their ratio by document, and whether that is too high."""
    holes, all_ = F.regexp_count(F.col(text), F.lit(tx.PLACEHOLDER)), tx.n_tokens(F.col(text))
    share = F.when(all_ > 0, holes / all_)
    return docs.select(key, holes.alias("placeholders"), all_.alias("tokens"), share.alias("share"), F.coalesce(share > most, F.lit(False)).alias("too_many"))


def forbidden(docs: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """Rows in which each pattern stands, all in one pass."""
    one = docs.agg(*[F.count_if(F.rlike(F.col(text), F.lit(p))).alias(n) for n, p in patterns.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(n).alias("n_rows")) for n in patterns])))


def worst(measured: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows of the greatest share; those without a token have none."""
    return measured.where("share IS NOT NULL").orderBy(F.desc("share"), key).limit(k)


def summary(measured: DataFrame) -> DataFrame:
    """All rows, those with too many placeholders, and those with nothing left."""
    return measured.agg(F.count(F.lit(1)).alias("n"), F.count_if("too_many").alias("too_many"), F.count_if(F.col("tokens") == 0).alias("empty"))
