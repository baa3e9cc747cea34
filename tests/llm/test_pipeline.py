import corpus_pipeline as pipeline
from tests.llm import test_jaccard, test_lines, test_packing, test_substring
from tests.llm.helpers import docs as documents
from tests.llm.helpers import words
from tidewake.llm import quality, shared
from tidewake.llm.shared import written


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_each_stage_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    steps = [docs]
    for name, stage in pipeline.STAGES:
        steps.append(written(stage(spark, steps[-1], sf), name.replace(" ", "-")))
    assert all(s.columns == docs.columns for s in steps[:-1])
    before = [texts(s) for s in steps[:-1]]

    verdict = {r.doc_id for r in quality.judged(docs, quality.learn(docs, labels)).where("kept").collect()}
    assert before[1] == {i: t for i, t in before[0].items() if i in verdict}

    kept = test_lines.expected(list(before[1].items()), 3)
    assert before[2] == {i: t for i, _, gone, t in kept if words(t) or not gone}

    classes = test_jaccard.expected(list(before[2].items()), 5, 80, 100)
    assert before[3] == {i: before[2][i] for i, _, head in classes if i == head}

    cut = test_substring.expected(list(before[3].items()), 50)
    assert before[4] == {i: t if gone else before[3][i] for i, _, gone, t in cut if t or not gone}
    assert all(r.n_chars == len(r.text) for r in steps[4].collect())

    assert test_packing.check(list(before[4].items()), steps[5].collect()) < 0.01
    assert [len(b) for b in before] == sorted((len(b) for b in before), reverse=True) and len(before[4]) > 500


def test_run_gives_the_last_stage(spark):
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100


def test_near_duplicates_keep_one_row_of_null_and_repeated_ids(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(200)) for x in "ab")
    rows = [(None, a), (None, a), (None, a + " x"), (7, b), (7, b)]
    left = pipeline.near_duplicates(spark, documents(spark, rows), "").collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in left) == [("7", "b"), ("None", "a")]


def odd(spark):
    from pyspark.sql import functions as F

    long = " ".join(f"long{k}" for k in range(40_000))
    plain = " ".join(f"p{k}" for k in range(60))
    rows = [(1, None), (2, ""), (3, plain), (3, plain), (None, plain), (None, None), (4, long), (5, long + " more"), (6, "one\ntwo\nthree " * 1), (7, plain.upper())]
    df = documents(spark, rows)
    for name in ("row", "id", "th", "kept", "a.b", "a b", "_key", "text_", "n_removed", "late", "spans"):
        df = df.withColumn(name, F.lit(99))
    return df


def test_stages_on_odd_rows(spark):
    df = odd(spark)
    none = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").limit(0)
    good = quality.keep_good(df, none)
    assert good.columns == df.columns and sorted(str(r.doc_id) for r in good.collect()) == ["3", "3", "4", "5", "7", "None"]
    cut = pipeline.line_dedup(spark, df, "")
    # The null id's row of 60 words in one line repeats document 3's.
    assert sorted((str(r.doc_id), r.text is None) for r in cut.collect()) == [("1", True), ("2", False), ("3", False), ("3", False), ("4", False), ("5", False), ("6", False), ("7", False), ("None", True)]
    assert cut.columns == df.columns and all(r["a.b"] == 99 and r["row"] == 99 for r in cut.collect())
    one = pipeline.near_duplicates(spark, df, "")
    assert one.columns == df.columns and sorted((str(r.doc_id), r.text is None) for r in one.collect()) == [("1", True), ("2", False), ("3", False), ("4", False), ("6", False), ("None", True)]
    sub = pipeline.substring_dedup(spark, df, "").collect()
    assert {str(r.doc_id): len((r.text or "").split()) for r in sub} == {"1": 0, "2": 0, "3": 60, "4": 40_000, "5": 1, "6": 3, "7": 60, "None": 0}
    pieces = pipeline.pack(spark, df, "")
    assert pieces.where("doc_id = 1").count() == 1 and pieces.select("sequence_id", "offset").distinct().count() == pieces.count()


def test_stages_on_an_empty_table(spark):
    df = odd(spark).limit(0)
    none = spark.read.parquet("/root/testdata/sf0.001/labels.parquet").limit(0)
    for out in (quality.keep_good(df, none), pipeline.line_dedup(spark, df, ""), pipeline.near_duplicates(spark, df, ""), pipeline.substring_dedup(spark, df, "")):
        assert out.columns == df.columns and out.count() == 0
    assert pipeline.pack(spark, df, "").count() == 0


def test_run_holds_one_stage_at_a_time(spark):
    shared.drop_written(spark)
    out = pipeline.run(spark, "/root/testdata/sf0.001")
    left = [p.rpartition("/")[2].rpartition("-")[0] for p in shared._PATHS[spark.sparkContext.applicationId]]
    assert [n for n in left if not n.startswith("packing")] == ["pipeline-substring-dedup"] and out.count() > 100
