import os

from tidewake.llm import shared


def test_written_tables_can_be_dropped(spark):
    shared.drop_written(spark)
    df = shared.written(spark.range(3).toDF("id"), "some")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 3 and os.path.exists(path)
    assert shared.drop_written(spark) == 1 and not os.path.exists(path) and shared.drop_written(spark) == 0


def test_any_name_can_be_read(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a.b", "a`b", "a b"])
    assert [tuple(r.row) for r in df.select(shared.as_row(df).alias("row")).collect()] == [(1, 2, 3)]


def test_a_written_table_leaves_no_shuffle_files(spark):
    def left():
        return len([f for d in spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString() for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")])

    before, setting = left(), spark.conf.get(shared.CLEANED)
    df = spark.range(1000).selectExpr("id % 7 AS a", "id AS b")
    out = shared.written(df.join(df.groupBy("a").count().hint("merge"), "a"), "shuffled")
    assert left() <= before and out.count() == 1000 and spark.conf.get(shared.CLEANED) == setting


def test_tables_are_dropped_one_by_one(spark):
    with shared.noted() as paths:
        a, b = (shared.written(spark.range(n).toDF("id"), "some") for n in (3, 0))
    shared.drop(a)
    assert [os.path.exists(p.removeprefix("file://")) for p in paths] == [False, True]
    shared.drop(b)
    assert not os.path.exists(paths[1].removeprefix("file://")) and shared._NOTED.get() is None
