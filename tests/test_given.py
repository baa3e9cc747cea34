"""Registered queries against their SQL on small tables made for one fault each."""

import re
import tempfile
import time as clock

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connection
from tidewake.functions import text as tx
from tidewake.operators import contrast as con
from tidewake.operators import redaction as red
from tidewake.plans import QUERIES, SQL, files, ratings

SF = "/root/testdata/sf0.01"


def given(spark, name, rows, schema):
    """A folder with one table, and a connection that sees it."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{path}/{name}.parquet")
    con = duckdb.connect()
    con.sql(f"create view {name} as select * from read_parquet('{path}/{name}.parquet/*.parquet')")
    return path, con


def documents(spark, texts):
    return given(spark, "documents", [(k, t, "en", "web", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_a_beginning_ends_before_a_letter_with_an_accent(spark):
    path, con = documents(spark, ["Leètre x", "le chat", "LE", "Lex", "the_x", "der.", "Eĺ x", "der x", "le9"])
    assert compare(spark, con, QUERIES["marker_flags"], SQL["marker_flags"], path) is None
    assert {r.doc_id for r in QUERIES["marker_flags"](spark, path).where("begins_so").collect()} == {0, 1, 2, 5, 6, 7}


def test_every_array_of_a_task_is_read_back(spark, monkeypatch):
    monkeypatch.setattr(files, "SHARD", 3)  # more arrays than tasks
    assert compare(spark, connection(SF), QUERIES["owner_teams"], SQL["owner_teams"], SF) is None


TEMPLATES = [
    "Hi a.b@c.de, see HTTP://x.y/z?q=1) 12 at Acme", "hi  f@g.h see https://q 7-at acme", "no sign: x@ y@@z 'k'@m.n.", "", " ", "\n\t 12  ", "a b  c\n\nd", "É é://u x", "a1b a b",
    "https://", "://@ x", "A.\tB", "K@x ſ@y",
]


def test_template_texts_as_step_by_step(spark):
    def by_steps(t):
        t = F.lower(t)
        for pattern in (tx.URL, tx.LOWER_EMAIL, r"\d+", r"[^a-z ]"):
            t = F.regexp_replace(t, pattern, " ")
        return F.trim(F.regexp_replace(t, r"\s+", " "))

    rows = spark.createDataFrame([(t,) for t in [*TEMPLATES, None]], "text string").select("text", by_steps(F.col("text")).alias("want"), tx.template_text(F.col("text")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def hashes(df):
    """How often the texts are hashed in a plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("md5(")


def test_texts_are_hashed_before_the_plan_that_counts_them(spark):
    path, con = documents(spark, [*TEMPLATES, *TEMPLATES[:4], "one two three four five six seven eight nine ten"] * 3)
    assert hashes(QUERIES["template_repeats"](spark, path)) == 0
    assert compare(spark, con, QUERIES["template_repeats"], SQL["template_repeats"], path) is None


@pytest.mark.parametrize("name", ["score_depth", "repeat_dose", "bucket_tables"])
def test_graded_texts_are_read_once(spark, name):
    assert hashes(QUERIES[name](spark, SF)) == 0 and "text#" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_fits_read_what_was_graded(spark, monkeypatch):
    made = []
    monkeypatch.setattr(tx, "template_text", lambda c, f=tx.template_text: made.append(1) or f(c))
    frames = []
    monkeypatch.setattr(con, "fixed_effects", lambda frame, columns, f=con.fixed_effects: frames.append(hashes(frame)) or f(frame, columns))
    assert compare(spark, connection(SF), QUERIES["score_discriminance"], SQL["score_discriminance"], SF) is None
    assert len(made) == 1 and frames == [0, 0, 0, 0]


def test_labels_that_repeat_count_as_often_and_leave_templates_as_they_are(spark):
    texts = ["one two three four " * 12] * 3 + ["five six seven eight nine " * 20] * 2 + ["ten"]
    path, con_ = documents(spark, texts)
    labels = [(k, k % 2, 0) for k in range(5)] + [(0, 1, 1), (77, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    con_.sql(f"create view labels as select * from read_parquet('{path}/labels.parquet/*.parquet')")
    got = ratings._graded(spark, path).collect()
    assert sorted((r.doc_id, r.repeats) for r in got) == [(0, 3), (0, 3), (1, 3), (2, 3), (3, 2), (4, 2)]


def test_the_end_of_a_body_is_not_sought_at_each_image(spark):
    page = "<p>" + "one two three<br>" * 4000 + "<img>" * 4000 + "</p>"
    began = clock.perf_counter()
    page_ = spark.createDataFrame([(page,)], "html string").select(tx.rendered(F.col("html")).alias("page"))
    (got,) = page_.select(tx.clean_body(F.lit(""), F.col("page")).alias("c")).select("c.formatting.*").collect()
    assert got.n_images == 0 and clock.perf_counter() - began < 20  # all images begin where the body ends


QUOTED = [
    "a\n > b\nc>\n>d", "a\nOn some day, Ann écrit :\nb", "a\n  -- original message --\nb", "a\n---forwarded MESSAGE---\nb", "a\nvon: x\nb", "a\nDE : x\nb", "a\n____________\t\nb",
    "a\nFrom: x\nTo: y\nb", "a\nfrom: x\ny\nz\nDate: w", "a\nFrom: x\nplain\nb", "a\r\nOn b\rc\x0bDe Von From:", "From: x\nSent: y", "", "\n\n", "a　\n　>b\n\tOn the way wrote:", "a\nOn x\nDear", None,
]


def test_quotes_are_cut_as_line_by_line(spark):
    def plain(text):
        text = re.sub("\r\n|[\n\x0b\f\r\x1c-\x1e\x85  ]", "\n", re.split(r"(?is)\n[^\S\n]*On .{0,200}?\bwrote\s*:", text or "", maxsplit=1)[0])
        own = text.split("\n")
        patterns = [(p.replace("(?iU)", ""), re.I if "(?iU)" in p else 0) for p in tx.TRAIL_LINES]
        old = lambda k: any(re.search(p, own[k].strip(), f) for p, f in patterns) or (
            re.search("(?i)^From:\\s*.+", own[k].strip()) and re.search(tx.AFTER_FROM.replace("(?iU)", "(?i)"), " ".join(x.strip() for x in own[k + 1 : k + 4])))
        own = own[: next((k for k in range(len(own)) if old(k)), None)]
        return re.sub(r"\n\s*\n\s*\n+", "\n\n", "\n".join(x for x in own if not x.strip().startswith(">"))).strip()

    rows = spark.createDataFrame([(t,) for t in QUOTED], "text string").select("text", tx.without_quotes(F.col("text")).alias("got"))
    assert [r.got for r in rows.collect()] == [plain(t) for t in QUOTED]
    assert rows._jdf.queryExecution().executedPlan().toString().count("array_min(") == 1  # lines are looked through once


def test_identifiers_are_taken_out_once_and_texts_meet_one_join(spark):
    docs = spark.createDataFrame([(1, "a@b.c Ann Lee, ann", 7), (2, None, 8), (3, "none", 9)], "id long, text string, other int")
    out = red.redacted_by(docs, "id", "text", spark.createDataFrame([("ann lee",), ("ann",)], "token string"))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("Join LeftOuter") == 1 and "[EMAIL]" not in plan
    assert sorted(map(tuple, out.collect())) == [(1, "[EMAIL] [SENDER]", 7), (2, "", 8), (3, "none", 9)]
