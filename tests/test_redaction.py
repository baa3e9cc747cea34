"""Redaction by a vocabulary table against the one pattern of all its terms, and texts that are long in one thing."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tidewake.functions import text as tx
from tidewake.operators import redaction as red

LONG = 100_000


def shown(spark, texts, terms):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    vocabulary = spark.createDataFrame([(t,) for t in terms], "token string")
    return dict(map(tuple, red.redacted_by(docs, "id", "text", vocabulary).select("id", "text").collect()))


def by_pattern(spark, texts, terms):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    return dict(map(tuple, docs.select("id", tx.redacted(F.col("text"), vocabulary=[t.lower() for t in terms])).collect()))


TEXTS = [
    "Ann Lee met Ann, Anna and annlee; ANN LEE!", "ann  lee (two blanks) is ann and lee", "Jean-Luc O'Neil, jean luc", "", "nothing here", "Émile, émile | Emile",
    "see https://ann.example/lee and ann@lee.example in 2024", "[SENDER] ann | lee, ann", "ann", "Ann_Lee ann_lee2", "lee ann lee ann lee ann lee", "ß Strasse STRASSE straße",
]
TERMS = ["ann", "lee", "ann lee", "lee ann lee", "jean-luc", "jean luc", "o'neil", "émile", "straße", "straße", "annlee2"]


def test_table_and_pattern_give_the_same_text(spark):
    assert shown(spark, TEXTS, TERMS) == by_pattern(spark, TEXTS, TERMS)


@pytest.mark.parametrize("seed", range(3))
def test_overlapping_terms_too(spark, seed):
    rng = random.Random(seed)
    words = ["ab", "b", "abc", "c-d", "d"]
    join = lambda n: "".join(rng.choice(words) + rng.choice([" ", "-", ", "]) for _ in range(n)).rstrip(" -,")
    terms = {join(rng.randrange(1, 4)) for _ in range(12)}
    texts = [join(30) for _ in range(20)]
    assert shown(spark, texts, sorted(terms)) == by_pattern(spark, texts, sorted(terms))


def test_a_hundred_thousand_names(spark):
    names = [f"name{k:06}x" for k in range(LONG)]
    docs = spark.range(50).select("id", F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(400)), lambda k: F.concat(F.lit("NAME"), F.lpad(((F.col("id") * 7919 + k * 31) % 200_000).cast("string"), 6, "0"), F.lit("x said")))).alias("text"))
    vocabulary = spark.range(LONG).select(F.concat(F.lit("name"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("x")).alias("token"))
    got = red.redacted_by(docs, "id", "text", vocabulary).select("id", F.regexp_count("text", F.lit(r"\[SENDER\]")).alias("n")).collect()
    assert {r.id: r.n for r in got} == {i: sum((i * 7919 + k * 31) % 200_000 < LONG for k in range(401)) for i in range(50)} and len(names) == LONG


def test_nulls_keys_and_columns_stay(spark):
    docs = spark.createDataFrame([("x", None, 1), ("y", "ann", 2)], "key string, text string, first int")
    out = red.redacted_by(docs, "key", "text", spark.createDataFrame([("Ann",), (None,), ("",), ("-",)], "token string")).collect()
    assert sorted(map(tuple, out)) == [("x", "", 1), ("y", "[SENDER]", 2)]


@pytest.mark.parametrize(
    ("name", "expression", "want"),
    [
        ("prefixes", lambda: tx.norm_subject(F.repeat(F.lit("Re: "), LONG)), ""),
        ("tags", lambda: tx.norm_subject(F.concat(F.repeat(F.lit("[x] FW: aw : "), F.lit(LONG)), F.lit("Plan B"))), "plan b"),
        ("marks", lambda: tx.redacted(F.repeat(F.lit("the de | "), LONG), vocabulary=["the", "de"]), "[SENDER]"),
        ("blanks", lambda: F.length(tx.stripped(F.concat(F.lit("a"), F.repeat(F.lit(" "), LONG), F.lit("b ")))), LONG + 2),
        ("blank lines", lambda: tx.n_bullets(F.concat(F.repeat(F.lit("\n"), LONG), F.lit("- a"))), 1),
        ("blank lines and a quote", lambda: F.length(tx.without_quotes(F.concat(F.lit("a"), F.repeat(F.lit("\n "), LONG), F.lit("b")))), None),
        ("dots", lambda: tx.n_sentences(F.concat(F.repeat(F.lit("!"), LONG), F.lit("a b c"))), 1),
        ("letters", lambda: F.length(tx.redacted(F.repeat(F.lit("a"), LONG))), LONG),
        ("addresses", lambda: tx.redacted(F.lit("a@b_c@d 'x'@y.z")), "[EMAIL][EMAIL] [EMAIL]"),
        ("tidy", lambda: tx.tidied(F.concat(F.lit("a"), F.repeat(F.lit("\n 　"), LONG), F.lit("b"))), "a\n\n \u3000b"),
    ],
)
def test_long_runs_take_linear_time(spark, name, expression, want):
    began = time.perf_counter()
    got = spark.range(1).select(expression().alias("v")).first()["v"]
    assert (want is None or got == want) and time.perf_counter() - began < 15, name


def test_stacked_prefixes_as_before(spark):
    cases = {"Re: FW: [ext] re : Hello": "hello", "[tag] Hello": "tag hello", "Re:": "", "[a] [b] Re: x": "a b re x", "  AW:Antw: x": "x", "Reply: x": "reply x", "Auto-Reply: Re: y": "y"}
    got = spark.createDataFrame([(k,) for k in cases], "s string").select("s", tx.norm_subject(F.col("s")).alias("n")).collect()
    assert {r.s: r.n for r in got} == cases
