"""Queries that build and audit an analysis frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators import frame as fr
from tidewake.plans import time
from tidewake.sources.tables import load, touches


def _routes(spark: SparkSession, sf: str) -> DataFrame:
    """Touches as captured twice: every third one again, ten minutes later, with the tool that sent it."""
    t = touches(spark, sf).select("event_id", "entity", "channel", "ts", "sender")
    sync = t.withColumn("tool", F.lit(None).cast("string"))
    log = t.where("event_id % 3 = 0").select(
        (-F.col("event_id") - 1).alias("event_id"), "entity", "channel", (F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("ts"), "sender",
        F.concat(F.lit("tool"), (F.col("sender") % 3).cast("string")).alias("tool"),
    )
    return fr.united(sync, log)


def cross_route_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return fr.deduplicated_routes(_routes(spark, sf), ["entity", "channel"]).select("event_id", "entity", "channel", "route")


def route_twin(spark: SparkSession, sf: str) -> DataFrame:
    """The tool that any capture of the same event names."""
    log = _routes(spark, sf).withColumn("bucket", fr.time_bucket("ts"))
    tools = log.where("tool IS NOT NULL").groupBy("entity", "channel", "bucket").agg(F.min_by("tool", F.struct("ts", "event_id")).alias("twin"))
    return log.where("route = 'sync'").join(tools, ["entity", "channel", "bucket"], "left").select("event_id", "twin")


def resumable_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Touches that are not there yet when all clicks of the first half of the month are."""
    t = touches(spark, sf)
    return fr.missing(t, t.where((F.col("channel") == "click") & (F.dayofmonth("ts") <= 15)), "event_id").groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"))


def foreign_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The nations whose rows a read of well-funded customers will need."""
    wanted = load(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("n_nationkey")).distinct()
    return load(spark, sf, "nation").join(wanted, "n_nationkey", "left_semi").select("n_nationkey", "n_name")


def eligibility_waterfall(spark: SparkSession, sf: str) -> DataFrame:
    heads = time._heads(spark, sf)
    back = time.lookback_exclusion(spark, sf).withColumn("looked_back", F.lit(True))
    df = heads.join(back, time.KEY, "left")
    steps = [
        ("view", F.col("channel") == "view"), ("no look-back", F.col("looked_back").isNull()), ("sender in cohort", F.col("sender") < 15),
        ("has a next session", F.col("next_start").isNotNull()), ("value known", F.col("value") > 1),
    ]
    return fr.waterfall(df, steps)


def fill_rates(spark: SparkSession, sf: str) -> DataFrame:
    df = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")
    return fr.fill_rates(df, ["text", "lang", "source", "quality", "toxic"]).withColumn("share", F.round("share", 6))


def fill_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """By month of the order: how many orders have a returned line."""
    o, returned = load(spark, sf, "orders"), load(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    df = o.join(returned.withColumn("hit", F.lit(1)), "o_orderkey", "left")
    out = df.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("filled"))
    return out.withColumn("share", F.round(F.col("filled") / F.col("n"), 6))


def crosstab_shares(spark: SparkSession, sf: str) -> DataFrame:
    return fr.crosstab(load(spark, sf, "orders"), "o_orderpriority", "o_orderstatus").withColumn("share", F.round("share", 6))


def ranked_lookup_join(spark: SparkSession, sf: str) -> DataFrame:
    """For each order a supplier of the customer's nation among its lines, else that of its first line."""
    o, c = load(spark, sf, "orders"), load(spark, sf, "customer")
    li, s = load(spark, sf, "lineitem"), load(spark, sf, "supplier")
    owners = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "c_nationkey")
    offered = li.join(s, li["l_suppkey"] == s["s_suppkey"])
    offered = offered.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "s_suppkey", "s_nationkey").join(owners, "o_orderkey")
    found = fr.ranked_lookup(owners.select("o_orderkey"), offered, "o_orderkey", F.col("s_nationkey") == F.col("c_nationkey"), "l_linenumber", "s_suppkey")
    return found.select("o_orderkey", "s_suppkey", "how")


def coalesce_dimension(spark: SparkSession, sf: str) -> DataFrame:
    n, r = load(spark, sf, "nation"), load(spark, sf, "region")
    c = load(spark, sf, "customer").withColumn("segment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise(""))
    nations = n.join(r, n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(" ").alias("n_name"), "r_name")
    df = c.join(nations, c["c_nationkey"] == nations["n_nationkey"], "left")
    return df.select("c_custkey", fr.first_filled("segment", "n_name", "r_name").alias("label"))


def visibility_gate(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("sender"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_orderkey").alias("thread_id"), "l_returnflag"
    )
    out, back = li.where("l_returnflag = 'N'"), li.where("l_returnflag = 'R'")
    return fr.visible_months(out, back, back)


def gated_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of sender months that pass the gate, counted by sender."""
    ok = visibility_gate(spark, sf).where("ok").select("sender", "month")
    li = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("sender"), F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    return li.join(ok, ["sender", "month"], "left_semi").groupBy("sender").agg(F.count(F.lit(1)).alias("n"))


def time_range_chunks(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders")
    return fr.range_chunks(o, F.unix_date(F.to_date("o_orderdate")), F.year("o_orderdate"), 500)


def batch_assignment(spark: SparkSession, sf: str) -> DataFrame:
    out = fr.numbered(load(spark, sf, "documents").select("doc_id"), "doc_id")
    return out.groupBy(F.floor(F.col("nth") / 40).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return fr.sampled(load(spark, sf, "documents").select("doc_id", "lang"), "doc_id", "first", 50)


def booster_sample(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "lang")
    return fr.booster(docs, fr.sampled(docs, "doc_id", "first", 50), "doc_id", "lang", "more", 20)


def equal_size_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Repeat share of texts by language after cutting all languages to the size of the smallest."""
    docs = load(spark, sf, "documents").select("doc_id", "lang", F.md5("text").alias("hash"))
    least = docs.groupBy("lang").count().agg(F.min("count").alias("least"))
    order = fr.hashed("doc_id", "cut")
    cut = fr.ranked(docs, ["lang"], fr.hash_part(order), [order, F.col("doc_id")], "nth").join(F.broadcast(least)).where("nth < least")
    per = cut.groupBy("lang", "hash").count()
    out = per.groupBy("lang").agg(F.sum("count").alias("n"), F.sum(F.when(F.col("count") > 1, F.col("count")).otherwise(0)).alias("repeated"))
    return out.withColumn("share", F.round(F.col("repeated") / F.col("n"), 6))


NAMES = (
    "cross_route_dedup route_twin resumable_ingest foreign_ids eligibility_waterfall fill_rates fill_by_month crosstab_shares ranked_lookup_join "
    "coalesce_dimension visibility_gate gated_rows time_range_chunks batch_assignment hash_sample booster_sample equal_size_repeats"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

_ROUTES = (
    "WITH"
    + time._LOG
    + """, routes AS (
        SELECT event_id, entity, channel, ts, NULL AS tool, 'sync' AS route, 0 AS rank FROM touches
        UNION ALL
        SELECT -event_id - 1, entity, channel, ts + INTERVAL 10 MINUTE, 'tool' || (sender % 3), 'log', 1 FROM touches WHERE event_id % 3 = 0),
    keyed AS (SELECT *, epoch_us(ts) // 7200000000 AS bucket FROM routes)"""
)
_GATE = """WITH li AS (SELECT l_suppkey AS sender, strftime(l_shipdate, '%Y-%m') AS month, l_orderkey AS thread_id, l_returnflag AS flag FROM lineitem),
    base AS (SELECT sender, month, count(*) AS n_out FROM li WHERE flag = 'N' GROUP BY 1, 2),
    back AS (SELECT sender, month, count(*) AS n_to FROM li WHERE flag = 'R' GROUP BY 1, 2),
    own AS (SELECT DISTINCT sender, month, thread_id FROM li WHERE flag = 'N'),
    seen AS (SELECT DISTINCT thread_id, month FROM li WHERE flag = 'R'),
    thread AS (SELECT sender, month, count(*) AS n_thread FROM own JOIN seen USING (thread_id, month) GROUP BY 1, 2),
    gate AS (
        SELECT sender, month, n_out, coalesce(n_to, 0) AS n_to, coalesce(n_thread, 0) AS n_thread, greatest(coalesce(n_to, 0), coalesce(n_thread, 0)) > 0 AS ok
        FROM base LEFT JOIN back USING (sender, month) LEFT JOIN thread USING (sender, month))"""
_STEPS = ["channel = 'view'", "back IS NULL", "sender < 15", "next_us IS NOT NULL", "value > 1"]
_STEP_NAMES = ["view", "no look-back", "sender in cohort", "has a next session", "value known"]

SQL = {
    "cross_route_dedup": _ROUTES
    + """ SELECT event_id, entity, channel, route FROM (
            SELECT *, row_number() OVER (PARTITION BY entity, channel, bucket ORDER BY rank, ts, event_id) AS n FROM keyed) WHERE n = 1""",
    "route_twin": _ROUTES
    + """, tools AS (SELECT entity, channel, bucket, arg_min(tool, (ts, event_id)) AS twin FROM keyed WHERE tool IS NOT NULL GROUP BY 1, 2, 3)
          SELECT event_id, twin FROM keyed LEFT JOIN tools USING (entity, channel, bucket) WHERE route = 'sync'""",
    "resumable_ingest": """SELECT event_type AS channel, count(*) AS n, min(event_id) AS first_id FROM events
        WHERE event_type = 'view' OR (event_type = 'click' AND day(ts) > 15) GROUP BY 1""",
    "foreign_ids": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000)",
    "eligibility_waterfall": "WITH"
    + time._LOG
    + """, marked AS (
            SELECT h.*, e.value, (SELECT 1 WHERE EXISTS (SELECT 1 FROM answers a WHERE a.entity = h.entity AND a.us >= h.us - 86400000000 AND a.us < h.us)) AS back
            FROM heads h JOIN events e USING (event_id)),
          counts AS (SELECT count(*) AS s0, """
    + ", ".join(f"count(*) FILTER (WHERE {' AND '.join(_STEPS[: i + 1])}) AS s{i + 1}" for i in range(5))
    + " FROM marked) SELECT CAST(0 AS INTEGER) AS step, 'all' AS name, s0 AS n, CAST(0 AS BIGINT) AS dropped FROM counts"
    + "".join(f" UNION ALL SELECT {i + 1}, '{_STEP_NAMES[i]}', s{i + 1}, s{i} - s{i + 1} FROM counts" for i in range(5)),
    "fill_rates": " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '') AS filled,
            round(count(*) FILTER (WHERE {c} IS NOT NULL AND CAST({c} AS VARCHAR) <> '') / count(*), 6) AS share FROM documents LEFT JOIN labels USING (doc_id)"""
        for c in ("text", "lang", "source", "quality", "toxic")
    ),
    "fill_by_month": """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(*) FILTER (WHERE hit) AS filled, round(count(*) FILTER (WHERE hit) / count(*), 6) AS share
        FROM (SELECT *, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS hit FROM orders) GROUP BY 1""",
    "crosstab_shares": """WITH cells AS (
            SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS o_orderpriority,
                   CASE WHEN grouping(o_orderstatus) = 1 THEN 'all' ELSE o_orderstatus END AS o_orderstatus, count(*) AS n
            FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus))
        SELECT o_orderpriority, o_orderstatus, n, round(n / max(CASE WHEN o_orderstatus = 'all' THEN n END) OVER (PARTITION BY o_orderpriority), 6) AS share FROM cells""",
    "ranked_lookup_join": """WITH owners AS (SELECT o_orderkey, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey),
        offered AS (
            SELECT l_orderkey AS o_orderkey, s_suppkey, s_nationkey = c_nationkey AS hit,
                   row_number() OVER (PARTITION BY l_orderkey ORDER BY s_nationkey = c_nationkey DESC, l_linenumber, s_suppkey) AS n
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN owners ON o_orderkey = l_orderkey)
        SELECT o.o_orderkey, s_suppkey, CASE WHEN hit THEN 'match' WHEN NOT hit THEN 'first' ELSE 'none' END AS how
        FROM owners o LEFT JOIN (SELECT * FROM offered WHERE n = 1) f ON f.o_orderkey = o.o_orderkey""",
    "coalesce_dimension": """SELECT c_custkey, coalesce(CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS label
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
    "visibility_gate": _GATE + " SELECT * FROM gate",
    "gated_rows": _GATE + " SELECT sender, count(*) AS n FROM li WHERE EXISTS (SELECT 1 FROM gate g WHERE g.ok AND g.sender = li.sender AND g.month = li.month) GROUP BY 1",
    "time_range_chunks": """WITH fine AS (
            SELECT CAST(year(o_orderdate) AS INTEGER) AS period, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS bucket, count(*) AS n FROM orders GROUP BY 1, 2),
        sums AS (SELECT period, level, bucket // (1 << level) AS part, min(bucket) AS low, max(bucket) AS high, sum(n) AS n FROM fine, range(0, 21) t(level) GROUP BY 1, 2, 3)
        SELECT s.period, s.low, s.high, CAST(s.n AS BIGINT) AS n FROM sums s LEFT JOIN sums d ON d.period = s.period AND d.level = s.level + 1 AND d.part = s.part // 2
        WHERE (s.n <= 500 OR s.level = 0) AND NOT coalesce(d.n <= 500, false)""",
    "batch_assignment": """SELECT nth // 40 AS batch, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id
        FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS nth FROM documents) GROUP BY 1""",
    "hash_sample": "SELECT doc_id, lang FROM documents ORDER BY md5(doc_id || '#first'), doc_id LIMIT 50",
    "booster_sample": """WITH first AS (SELECT doc_id FROM documents ORDER BY md5(doc_id || '#first'), doc_id LIMIT 50)
        SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '#more'), doc_id) AS n FROM documents
            WHERE doc_id NOT IN (SELECT doc_id FROM first)) WHERE n <= 20""",
    "equal_size_repeats": """WITH d AS (SELECT lang, md5(text) AS hash, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || '#cut'), doc_id) AS nth FROM documents),
        least AS (SELECT min(n) AS n FROM (SELECT count(*) AS n FROM documents GROUP BY lang)),
        per AS (SELECT lang, hash, count(*) AS c FROM d, least WHERE nth <= n GROUP BY 1, 2)
        SELECT lang, CAST(sum(c) AS BIGINT) AS n, CAST(sum(CASE WHEN c > 1 THEN c ELSE 0 END) AS BIGINT) AS repeated, round(sum(CASE WHEN c > 1 THEN c ELSE 0 END) / sum(c), 6) AS share FROM per GROUP BY 1""",
}
