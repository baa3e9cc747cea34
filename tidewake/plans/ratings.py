"""Queries over rating passes, labels of responses and what they add up to.

Three raters look at each document: by its characters, by its words and by its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.functions import text as tx
from tidewake.functions.stats import correlation
from tidewake.operators import agreement as ag
from tidewake.operators import attribution as att
from tidewake.operators import contrast as con
from tidewake.operators import frame as fr
from tidewake.operators import funnel
from tidewake.operators import sessions as ses
from tidewake.plans import time
from tidewake.sources.scratch import written
from tidewake.sources.tables import event_log, load, responses, spread, touches

SCALES, FLAGS = ["depth", "clean"], ["apt"]
MEANING = {"purchase": True, "signup": True, "error": False, "view": None}


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _pass(spark: SparkSession, sf: str, size: str, symbols: int, apt: str) -> DataFrame:
    d = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id")
    n_symbols = F.regexp_count("text", F.lit(r"[#*$%&|<>]"))
    sizes = {"chars": F.length("text"), "words": 6 * F.regexp_count("text", F.lit(r"\S+")), "lines": 40 * F.size(F.split("text", "\n", -1))}
    return d.select(
        "doc_id", F.least(F.lit(5), F.floor(F.log10(sizes[size] + 1)).cast("int") + 1).alias("depth"),
        F.least(F.lit(5), F.floor(n_symbols / symbols).cast("int") + 1).alias("clean"), F.expr(apt).alias("apt"),
    )


def _passes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(_pass(spark, sf, *p) for p in (("chars", 1, "quality = 1"), ("words", 2, "n_chars > 400"), ("lines", 5, "toxic = 0")))


_AGREE = ("exact", "within_one", "top_agree", "kappa", "rate_a", "rate_b", "r")


def rating_agreement(spark: SparkSession, sf: str) -> DataFrame:
    first, again, _ = _passes(spark, sf)
    return _rounded(ag.rating_agreement(first, again, "doc_id", SCALES, FLAGS), *_AGREE)


def self_against_cross(spark: SparkSession, sf: str) -> DataFrame:
    first, again, other = _passes(spark, sf)
    own, cross = (ag.rating_agreement(first, b, "doc_id", SCALES, FLAGS) for b in (again, other))
    return _rounded(ag.self_against_cross(own, cross), "kappa_self", "kappa_cross", "lost")


def score_levels(spark: SparkSession, sf: str) -> DataFrame:
    first, _, _ = _passes(spark, sf)
    rows = first.join(load(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return _rounded(ag.levels(rows, "lang", "depth"), "share", "mean")


def label_map(spark: SparkSession, sf: str) -> DataFrame:
    """What each event type says of an answer: yes, no or nothing."""
    out = ag.mapped(event_log(spark, sf), "channel", MEANING).groupBy("channel", "mapped")
    return out.agg(F.count(F.lit(1)).alias("n"))


def first_wins_overlay(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of three passes, each over part of the ids: the earliest pass that has an id counts."""
    all_ = load(spark, sf, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    bad, good = (all_.where(c).select("id", F.lit(n).alias("label")) for c, n in (("toxic = 1", "toxic"), ("quality = 1", "good")))
    return ag.overlaid([bad, good, all_.select("id", F.lit("plain").alias("label"))], first_wins=True)


def aligned_series(spark: SparkSession, sf: str) -> DataFrame:
    """By source: mean quality, share of toxic ones and documents, where all three are known."""
    d = load(spark, sf, "documents")
    rated = d.join(load(spark, sf, "labels"), "doc_id")
    parts = {
        "quality": rated.groupBy("source").agg(F.avg("quality").alias("v")), "toxic": rated.where("toxic = 1").groupBy("source").agg(F.count(F.lit(1)).alias("v")),
        "documents": d.groupBy("source").agg(F.count(F.lit(1)).alias("v")),
    }
    return _rounded(ag.aligned(parts, "source"), "quality")


def shared_ids(spark: SparkSession, sf: str) -> DataFrame:
    return fr.common(load(spark, sf, "documents"), load(spark, sf, "labels"), "doc_id")


def run_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """One row on the labels as a result: parameters, rows, keys, and documents that have none."""
    return ag.manifest(load(spark, sf, "labels"), "doc_id", load(spark, sf, "documents"), rubric="first", rater="driver")


def top_values(spark: SparkSession, sf: str) -> DataFrame:
    return fr.top_values(load(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"], 4)


def fill_by_window(spark: SparkSession, sf: str) -> DataFrame:
    """Fill rates of properties by month half and direction of the event."""
    e = event_log(spark, sf).select(
        F.when(F.dayofmonth("ts") <= 15, "early").otherwise("late").alias("half"), F.when(F.col("channel").isin("purchase", "signup"), "in").otherwise("out").alias("direction"),
        F.when(F.col("value") > 5, F.col("value")).alias("high_value"), F.when(F.col("channel") != "error", F.col("thread_id")).alias("thread"),
    )
    long = e.select("half", "direction", F.inline(F.array(*[F.struct(F.lit(c).alias("property"), F.col(c).isNotNull().alias("filled")) for c in ("high_value", "thread")])))
    out = long.groupBy("half", "direction", "property").agg(F.count(F.lit(1)).alias("n"), F.count_if("filled").alias("filled"))
    return out.withColumn("share", F.round(F.col("filled") / F.col("n"), 6))


def ordinal_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Categories as numbers: priorities by their rank, a status as 0 or 1."""
    rank = F.create_map(*[F.lit(x) for k, v in {"1-URGENT": 5.0, "2-HIGH": 4.0, "3-MEDIUM": 3.0, "4-NOT SPECIFIED": 2.0, "5-LOW": 1.0}.items() for x in (k, v)])
    o = load(spark, sf, "orders").select("o_orderstatus", F.try_element_at(rank, F.col("o_orderpriority")).alias("level"), (F.col("o_orderstatus") == "F").cast("double").alias("done"))
    return _rounded(o.groupBy("o_orderstatus").agg(F.avg("level").alias("level"), F.avg("done").alias("done")), "level")


def channel_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Each event's channel by what captured it, its sender with a fallback, its value as a number or null, and whether
    the sender is one of ours."""
    e = event_log(spark, sf)
    kind = F.when(F.col("channel") == "error", "tool").when((F.col("channel") == "view") & (F.col("value") > 10), "paid view").when(F.col("channel").isin("view", "click"), "own").otherwise("inbound")
    owner = F.when(F.col("sender") < 10, F.concat(F.lit("Owner."), F.col("sender").cast("string"), F.lit("@Ours.example"))).otherwise("")
    address = F.concat(F.lit("u"), F.col("entity").cast("string"), F.lit("@mail.example"))
    who = F.lower(fr.first_filled_of(owner, address))
    typed = F.when(F.col("channel") == "signup", F.lit("n/a")).otherwise(F.col("sender").cast("string")).try_cast("double")
    ours = spark.createDataFrame([("ours.example",)], "domain string")
    rows = e.select("event_id", kind.alias("kind"), F.substring_index(who, "@", 1).alias("local"), F.substring_index(who, "@", -1).alias("domain"), typed.alias("number"))
    rows = rows.join(F.broadcast(ours.withColumn("is_ours", F.lit(True))), "domain", "left")  # one row
    return rows.groupBy("kind", F.coalesce("is_ours", F.lit(False)).alias("is_ours")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("local").alias("senders"), F.count("number").alias("numbers"), F.min("local").alias("first_sender")
    )


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    heads, answers = time._heads(spark, sf), responses(spark, sf)
    labels = answers.where("value > 3").select(F.col("event_id").alias("response_id"), (F.col("channel") == "purchase").alias("human"), (F.col("value") > 12).alias("interested"))
    found = att.outcomes(att.candidates(heads, answers, time.ANSWER, "entity", "entity", 0), labels)
    return heads.join(found, time.KEY, "left").fillna({"n_candidates": 0, "n_labelled": 0, "replied": False, "interested": False})


def labelled_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """The outcome pair of each head by the labels of its candidates, and the time of the first reply by a person."""
    return _outcomes(spark, sf).select("event_id", *time.KEY, "n_candidates", "n_labelled", "replied", "interested", "reply_us")


def corpus_membership(spark: SparkSession, sf: str) -> DataFrame:
    """Events that head a session under any of three gaps, in how many, and the tightest."""
    parts = []
    for hours in (12, 24, 36):
        heads = ses.session_heads(ses.sessionized(touches(spark, sf), hours * ses.HOUR))
        parts.append(heads.select("event_id", F.lit(hours).alias("gap_hours")))
    return fr.distinct_union(parts, "event_id")


def policy_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """Over senders: how answer rates go with mean depth and with the share that reaches four touches."""
    out = funnel.sender_policy(time._stages(spark, sf), 20)
    one = out.agg(F.count(F.lit(1)).alias("senders"), correlation(F.col("mean_touches"), F.col("rate")).alias("r_depth"), correlation(F.col("share_reaching_4"), F.col("rate")).alias("r_reach"))
    return _rounded(one, "r_depth", "r_reach")


def _graded(spark: SparkSession, sf: str, *counted: str) -> DataFrame:
    """Labelled documents with a score from 0 to 5, rivals of it, and whether they are one of several of a template; with
    those of the other counted features that are asked for. Texts are read once: what is worked out of them is written,
    and texts meet no shuffle but that of the labels' ids where Spark doesn't broadcast those. Only labelled texts are counted."""
    t = F.col("text")
    words = F.regexp_count("text", F.lit(r"\S+"))
    features = {
        "paragraphs": lambda: tx.n_paragraphs(t), "bullets": lambda: tx.n_bullets(t), "links": lambda: tx.n_links(t),
        "first_question": lambda: tx.first_question_words(t), "sentences": lambda: tx.n_sentences(t),
    }
    labels = load(spark, sf, "labels")
    asked = labels.select("doc_id").distinct().withColumn("_asked", F.lit(True))
    d = spread(load(spark, sf, "documents").select("doc_id", "source", "lang", "text", "n_chars")).join(asked, "doc_id", "left")
    own = {"words": words, "symbols": F.regexp_count("text", F.lit(r"[#*$%&|<>]"))} | {n: features[n]() for n in counted}
    hashed = d.select("doc_id", "source", "lang", "n_chars", "_asked", F.md5(tx.template_text(t)).alias("hash"), *[F.when(F.col("_asked"), c).alias(n) for n, c in own.items()])
    hashed = written(hashed, "graded-texts")
    repeats = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("repeats"))
    rows = hashed.where("_asked").join(repeats, "hash").join(labels, "doc_id")
    graded = rows.select(
        "doc_id", F.col("source").alias("sender"), "lang", F.col("quality").alias("y"), "toxic", "repeats", F.least(F.lit(5), F.floor(F.col("words") / 40)).cast("int").alias("score"),
        (F.col("repeats") >= 2).cast("int").alias("x"), F.log10(F.col("n_chars") + 1).alias("log_chars"), *own,
    )
    return written(graded, "graded")  # several fits read it


def score_discriminance(spark: SparkSession, sf: str) -> DataFrame:
    """Is a score more than its rivals: its correlation with each, and its effect alone and with the rival as control."""
    g = _graded(spark, sf).where("score >= 1").select("sender", "y", (F.col("score") >= 4).cast("double").alias("hi"), "score", "log_chars", F.col("symbols").cast("double").alias("symbols"), F.col("toxic").cast("double").alias("toxic"))
    rivals = ["log_chars", "symbols", "toxic"]
    r = {x["b"]: x["r"] for x in ag.correlations(g, ["score"], rivals).collect()}
    alone = con.fixed_effects(g, ["hi"])[0]
    rows = []
    for name in rivals:
        fit = dict((t, (b, se)) for t, b, se in con.fixed_effects(g, ["hi", name]))
        rows.append((name, r[name], alone[1], fit["hi"][0], fit["hi"][1], fit[name][0]))
    out = spark.createDataFrame(rows, "rival string, r double, alone double, controlled double, se double, rival_effect double")
    return _rounded(out, "r", "alone", "controlled", "se", "rival_effect")


def score_depth(spark: SparkSession, sf: str) -> DataFrame:
    """A score by arm, of templates and of single texts: mean and shares, and the arm's effect on the score itself."""
    g = _graded(spark, sf)
    s = F.col("score")
    arms = g.groupBy("x").agg(
        F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean"), F.avg((s >= 1).cast("int")).alias("some"), F.avg((s >= 4).cast("int")).alias("high"),
        F.avg(F.when(s >= 1, (s >= 4).cast("int"))).alias("high_of_some"),
    )
    rows = g.select("sender", "x", "score", F.lit("all").alias("feature")).unionByName(g.where("score >= 1").select("sender", "x", "score", F.lit("some").alias("feature")))
    fits = con.fixed_effect(rows, y="score").groupBy().agg(F.max(F.when(F.col("feature") == "all", F.col("b"))).alias("effect"), F.max(F.when(F.col("feature") == "some", F.col("b"))).alias("effect_of_some"))
    return _rounded(arms.join(F.broadcast(fits)), "mean", "some", "high", "high_of_some", "effect", "effect_of_some")  # one row


def repeat_dose(spark: SparkSession, sf: str) -> DataFrame:
    """Among repeated texts: the effect of each doubling of their copies."""
    rows = _graded(spark, sf).where("repeats >= 2").select("sender", "y", F.ln("repeats").alias("x"), F.lit("copies").alias("feature"))
    fit = con.fixed_effect(rows).select("feature", (F.col("b") * F.ln(F.lit(2.0))).alias("per_doubling"), (F.col("se") * F.ln(F.lit(2.0))).alias("se"))
    return _rounded(fit, "per_doubling", "se")


TABLES = {
    "paragraphs": [-1, 0, 1, 3, 10, 1e9], "bullets": [-1, 0, 2, 1e9], "links": [-1, 0, 1e9], "first_question": [-1, 0, 8, 1e9], "sentences": [-1, 2, 10, 50, 1e9],
    "repeats": [0, 1, 2, 4, 9, 1e9], "score": [-1, 0, 1, 2, 3, 4, 5],
}


def bucket_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Rates of the outcome by buckets of each counted feature, from one read of the texts."""
    g = _graded(spark, sf, "paragraphs", "bullets", "links", "first_question", "sentences")
    return _rounded(con.bucket_tables(g, TABLES), "rate")


def template_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Templates by how many sources send them, with what the texts of each kind are like."""
    hashed = load(spark, sf, "documents").select("doc_id", "source", F.md5(tx.template_text(F.col("text"))).alias("hash"), F.regexp_count("text", F.lit(r"\S+")).alias("words"), "n_chars")
    per = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"), F.sum("words").alias("words"), F.sum("n_chars").alias("chars")).where("n >= 2")
    ratio = F.col("sources") / F.col("n")
    kind = F.when(ratio <= 0.34, "many from few").when(ratio >= 0.9, "one from each").otherwise("mixed")
    out = per.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("templates"), F.max("n").alias("most_copies"), (F.sum("words") / F.sum("n")).alias("mean_words"), (F.sum("chars") / F.sum("n")).alias("mean_chars"))
    return _rounded(out, "mean_words", "mean_chars")


NAMES = (
    "rating_agreement self_against_cross score_levels label_map first_wins_overlay aligned_series shared_ids run_manifest top_values fill_by_window "
    "ordinal_levels channel_classes labelled_outcomes corpus_membership policy_correlations score_discriminance score_depth repeat_dose bucket_tables template_profiles"
).split()
QUERIES = {n: globals()[n] for n in NAMES}


def _dim(a: str, b: str, name: str, flag: bool = False) -> str:
    top = lambda x: x if flag else f"{x} >= 4"
    within = "CAST(NULL AS DOUBLE)" if flag else f"avg(CASE WHEN abs({a} - {b}) <= 1 THEN 1.0 ELSE 0.0 END)"
    r = "CAST(NULL AS DOUBLE)" if flag else f"corr({a}, {b})"
    return f"""SELECT '{name}' AS dimension, count(*) AS n, avg(CASE WHEN {a} = {b} THEN 1.0 ELSE 0.0 END) AS exact, {within} AS within_one,
        avg(CASE WHEN ({top(a)}) = ({top(b)}) THEN 1.0 ELSE 0.0 END) AS top_agree, count(*) FILTER (WHERE {top(a)} AND {top(b)}) AS yy, count(*) FILTER (WHERE {top(a)}) AS na,
        count(*) FILTER (WHERE {top(b)}) AS nb, {r} AS r FROM p"""


_K = "((n - na - nb + 2 * yy) / n - ((na / n) * (nb / n) + (1 - na / n) * (1 - nb / n))) / (1 - ((na / n) * (nb / n) + (1 - na / n) * (1 - nb / n)))"
_KAPPA = f"CASE WHEN (na / n) * (nb / n) + (1 - na / n) * (1 - nb / n) < 1 THEN {_K} END"


def _size(x: str) -> str:
    return f"least(5, CAST(floor(log10({x} + 1)) AS INTEGER) + 1)"


_P = f"""WITH p AS (
    SELECT doc_id, lang, {_size("length(text)")} AS da, {_size("6 * len(regexp_extract_all(text, '\\S+'))")} AS db, {_size("40 * len(string_split(text, chr(10)))")} AS dc,
           least(5, s + 1) AS ca, least(5, s // 2 + 1) AS cb, least(5, s // 5 + 1) AS cc, quality = 1 AS fa, n_chars > 400 AS fb, toxic = 0 AS fc
    FROM (SELECT *, len(regexp_extract_all(text, '[#*$%&|<>]')) AS s FROM documents JOIN labels USING (doc_id)))"""


def _agreement(b: str, tag: str) -> str:
    return f"{tag} AS ({_dim('da', 'd' + b, 'depth')} UNION ALL {_dim('ca', 'c' + b, 'clean')} UNION ALL {_dim('fa', 'f' + b, 'apt', True)}), {tag}k AS (SELECT *, {_KAPPA} AS kappa FROM {tag})"


_TEMPLATE = """trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://[^\\s<>\\)\\]]+', ' ', 'g'),
    '[a-z0-9._%+\\-'']+@[a-z0-9.\\-]+', ' ', 'g'), '\\d+', ' ', 'g'), '[^a-z ]', ' ', 'g'), '\\s+', ' ', 'g'))"""
_QUESTIONS = """list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)),
    lambda x: suffix(x, '?') AND length(x) > 2 AND NOT regexp_matches(x, '(?i)(unsubscribe|not relevant to you|opt.?out|stop receiving|manage preferences)'))"""
_G = f"""WITH h AS (SELECT doc_id, source, lang, text, n_chars, md5({_TEMPLATE}) AS hash FROM documents),
    c AS (SELECT *, count(*) OVER (PARTITION BY hash) AS repeats FROM h),
    w AS (SELECT *, len(regexp_extract_all(text, '\\S+')) AS words, {_QUESTIONS} AS q FROM c JOIN labels USING (doc_id)),
    g AS (SELECT doc_id, source AS sender, lang, quality AS y, toxic, repeats, least(5, words // 40) AS score, CAST(repeats >= 2 AS INTEGER) AS x, log10(n_chars + 1) AS log_chars,
              len(regexp_extract_all(text, '[#*$%&|<>]')) AS symbols, words,
              len(list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda z: len(regexp_extract_all(z, '\\S+')) >= 4)) AS paragraphs,
              len(regexp_extract_all(text, '(?m)^\\s*[•\\-\\*]\\s+\\S')) AS bullets, len(regexp_extract_all(text, '(?i)https?://[^\\s<>\\)\\]]+')) AS links,
              CASE WHEN len(q) > 0 THEN len(regexp_extract_all(q[1], '\\S+')) ELSE 0 END AS first_question,
              len(list_filter(regexp_split_to_array(text, '(?:[.!?]+\\s+|\\n+)'), lambda z: len(regexp_extract_all(z, '\\S+')) >= 3)) AS sentences FROM w)"""


def _two(rival: str) -> str:
    """The score's effect with one control, by the same sums as the two-regressor model elsewhere."""
    return f"""SELECT '{rival}' AS rival, (SELECT corr(score, {rival}) FROM v) AS r, (SELECT sum(p * y) / sum(p * p) FROM d) AS alone, b1 AS controlled,
        sqrt(k * (qq * qq * m11 - 2 * qq * pq * m12 + pq * pq * m22)) / det AS se, b2 AS rival_effect FROM (
        SELECT *, n_g / (n_g - 1) * (n - 1) / (n - 2 - n_g) AS k FROM (
            SELECT b.*, sum(u1 * u1) AS m11, sum(u1 * u2) AS m12, sum(u2 * u2) AS m22 FROM (
                SELECT sender, sum(p * (y - b1 * p - b2 * q)) AS u1, sum(q * (y - b1 * p - b2 * q)) AS u2 FROM (SELECT sender, y, p, {rival}_d AS q FROM d), b_{rival} GROUP BY 1), b_{rival} b GROUP BY ALL))"""


def _sums(rival: str) -> str:
    return f"""b_{rival} AS (SELECT *, pp * qq - pq * pq AS det, (qq * py - pq * qy) / (pp * qq - pq * pq) AS b1, (pp * qy - pq * py) / (pp * qq - pq * pq) AS b2 FROM (
        SELECT sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(p * y) AS py, sum(q * y) AS qy, count(*) AS n, count(DISTINCT sender) AS n_g FROM (SELECT *, {rival}_d AS q FROM d)))"""


def _fe_sql(rows: str, tag: str) -> str:
    from tidewake.plans import contrast

    return contrast._fe(rows, tag)


def _bucket(name: str, edges: list[float]) -> str:
    names = ", ".join(f"({i}, {a!r}::DOUBLE, {b!r}::DOUBLE)" for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)))
    return f"""SELECT '{name}' AS "table", CAST(bucket AS INTEGER) AS bucket, low, high, count(doc_id) AS n, CAST(coalesce(sum(y), 0) AS BIGINT) AS k, round(avg(y), 6) AS rate
        FROM (VALUES {names}) t(bucket, low, high) LEFT JOIN g ON {name} > low AND {name} <= high GROUP BY ALL"""


def _member(hours: int) -> str:
    return f"""SELECT event_id, CAST({hours} AS INTEGER) AS gap_hours FROM (
        SELECT *, row_number() OVER (PARTITION BY entity, s ORDER BY ts, event_id) AS nth FROM (
            SELECT *, sum(CASE WHEN gap_us IS NULL OR gap_us >= {hours} * 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY entity ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM gapped)) WHERE nth = 1"""


SQL = {
    "rating_agreement": _P
    + ", "
    + _agreement("b", "t")
    + """ SELECT dimension, n, round(exact, 6) AS exact, round(within_one, 6) AS within_one, round(top_agree, 6) AS top_agree, round(kappa, 6) AS kappa, round(na / n, 6) AS rate_a,
          round(nb / n, 6) AS rate_b, round(r, 6) AS r, CASE WHEN kappa IS NULL THEN 'unknown' WHEN kappa < 0.4 THEN 'flagged' WHEN kappa < 0.6 THEN 'moderate' ELSE 'good' END AS verdict FROM tk""",
    "self_against_cross": _P
    + ", "
    + _agreement("b", "t")
    + ", "
    + _agreement("c", "u")
    + " SELECT dimension, round(tk.kappa, 6) AS kappa_self, round(uk.kappa, 6) AS kappa_cross, round(tk.kappa - uk.kappa, 6) AS lost FROM tk JOIN uk USING (dimension)",
    "score_levels": _P
    + """, c AS (SELECT lang, da AS depth, count(*) AS n FROM p GROUP BY 1, 2)
          SELECT lang, depth, n, round(n / sum(n) OVER w, 6) AS share, round(sum(depth * n) OVER w / sum(n) OVER w, 6) AS mean FROM c WINDOW w AS (PARTITION BY lang)""",
    "label_map": """SELECT event_type AS channel, CASE WHEN event_type IN ('purchase', 'signup') THEN true WHEN event_type = 'error' THEN false END AS mapped, count(*) AS n
        FROM events GROUP BY 1, 2""",
    "first_wins_overlay": "SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'plain' END AS label FROM labels",
    "aligned_series": """WITH r AS (SELECT * FROM documents JOIN labels USING (doc_id)),
        a AS (SELECT source, avg(quality) AS quality FROM r GROUP BY 1), b AS (SELECT source, CAST(count(*) AS DOUBLE) AS toxic FROM r WHERE toxic = 1 GROUP BY 1),
        c AS (SELECT source, CAST(count(*) AS DOUBLE) AS documents FROM documents GROUP BY 1)
        SELECT source, round(quality, 6) AS quality, toxic, documents FROM a JOIN b USING (source) JOIN c USING (source)""",
    "shared_ids": "SELECT count(*) AS n_common FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)",
    "run_manifest": """SELECT 'first' AS rubric, 'driver' AS rater, count(*) AS n_rows, count(DISTINCT doc_id) AS n_keys,
        (SELECT count(DISTINCT doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS n_gaps FROM labels""",
    "top_values": "WITH c AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY 1, 2" for c in ("o_orderpriority", "o_orderstatus", "o_custkey"))
    + ") SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS INTEGER) AS place FROM c) WHERE place <= 4",
    "fill_by_window": """WITH e AS (SELECT CASE WHEN day(ts) <= 15 THEN 'early' ELSE 'late' END AS half, CASE WHEN event_type IN ('purchase', 'signup') THEN 'in' ELSE 'out' END AS direction,
            value > 5 AS high_value, event_type <> 'error' AS thread FROM events),
        l AS (SELECT half, direction, 'high_value' AS property, high_value AS f FROM e UNION ALL SELECT half, direction, 'thread', thread FROM e)
        SELECT half, direction, property, count(*) AS n, count(*) FILTER (WHERE f) AS filled, round(count(*) FILTER (WHERE f) / count(*), 6) AS share FROM l GROUP BY 1, 2, 3""",
    "ordinal_levels": """SELECT o_orderstatus, round(avg(CAST(6 - CAST(o_orderpriority[1] AS INTEGER) AS DOUBLE)), 6) AS level, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS done
        FROM orders GROUP BY 1""",
    "channel_classes": """WITH e AS (
            SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 20 AS sender, CASE WHEN event_type = 'error' THEN 'tool' WHEN event_type = 'view' AND value > 10 THEN 'paid view'
                WHEN event_type IN ('view', 'click') THEN 'own' ELSE 'inbound' END AS kind FROM events)
        SELECT kind, sender < 10 AS is_ours, count(*) AS n, count(DISTINCT CASE WHEN sender < 10 THEN 'owner.' || sender ELSE 'u' || user_id END) AS senders,
               count(*) FILTER (WHERE event_type <> 'signup') AS numbers, min(CASE WHEN sender < 10 THEN 'owner.' || sender ELSE 'u' || user_id END) AS first_sender FROM e GROUP BY 1, 2""",
    "labelled_outcomes": "WITH"
    + time._LOG
    + """, l AS (SELECT event_id AS response_id, event_type = 'purchase' AS human, value > 12 AS interested FROM events WHERE event_type IN ('purchase', 'signup') AND value > 3),
          o AS (SELECT entity, session_no, count(*) AS n_candidates, count(human) AS n_labelled, bool_or(coalesce(human, false)) AS replied,
                       bool_or(coalesce(human AND interested, false)) AS interested, min(response_us) FILTER (WHERE human) AS reply_us FROM pairs LEFT JOIN l USING (response_id) GROUP BY 1, 2)
          SELECT event_id, entity, session_no, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_labelled, 0) AS n_labelled, coalesce(replied, false) AS replied,
                 coalesce(interested, false) AS interested, reply_us FROM heads LEFT JOIN o USING (entity, session_no)""",
    "corpus_membership": "WITH"
    + time._LOG
    + ", m AS ("
    + " UNION ALL ".join(_member(h) for h in (12, 24, 36))
    + ") SELECT event_id, min(gap_hours) AS gap_hours, count(*) AS n_frames FROM m GROUP BY 1",
    "policy_correlations": "WITH"
    + time._LOG
    + """, per AS (SELECT sender, entity, session_no, max(touch_no) AS depth, bool_or(replied) AS replied, min(touch_no) AS first FROM stages GROUP BY 1, 2, 3),
          s AS (SELECT sender, avg(depth) AS d, avg(CASE WHEN depth >= 4 THEN 1.0 ELSE 0.0 END) AS f, count(*) FILTER (WHERE replied) / count(*) FILTER (WHERE first = 1) AS rate
                FROM per GROUP BY 1 HAVING count(*) FILTER (WHERE first = 1) >= 20)
          SELECT count(*) AS senders, round(corr(d, rate), 6) AS r_depth, round(corr(f, rate), 6) AS r_reach FROM s""",
    "score_discriminance": _G
    + """, v AS (SELECT sender, CAST(y AS DOUBLE) AS y, CAST(score >= 4 AS DOUBLE) AS p, score, log_chars, CAST(symbols AS DOUBLE) AS symbols, CAST(toxic AS DOUBLE) AS toxic FROM g WHERE score >= 1),
          d AS (SELECT sender, y - avg(y) OVER w AS y, p - avg(p) OVER w AS p, log_chars - avg(log_chars) OVER w AS log_chars_d, symbols - avg(symbols) OVER w AS symbols_d,
                       toxic - avg(toxic) OVER w AS toxic_d FROM v WINDOW w AS (PARTITION BY sender)),"""
    + ",".join(map(_sums, ("log_chars", "symbols", "toxic")))
    + ", o AS ("
    + " UNION ALL ".join(map(_two, ("log_chars", "symbols", "toxic")))
    + ") SELECT rival, round(r, 6) AS r, round(alone, 6) AS alone, round(controlled, 6) AS controlled, round(se, 6) AS se, round(rival_effect, 6) AS rival_effect FROM o",
    "score_depth": _G
    + ", la AS (SELECT 'all' AS feature, sender, x, score AS y FROM g UNION ALL SELECT 'some', sender, x, score FROM g WHERE score >= 1),"
    + _fe_sql("la", "f")
    + """ SELECT x, count(*) AS n, round(avg(score), 6) AS mean, round(avg(CAST(score >= 1 AS INTEGER)), 6) AS some, round(avg(CAST(score >= 4 AS INTEGER)), 6) AS high,
          round(avg(CASE WHEN score >= 1 THEN CAST(score >= 4 AS INTEGER) END), 6) AS high_of_some, round((SELECT b FROM f WHERE feature = 'all'), 6) AS effect,
          round((SELECT b FROM f WHERE feature = 'some'), 6) AS effect_of_some FROM g GROUP BY 1""",
    "repeat_dose": _G
    + ", la AS (SELECT 'copies' AS feature, sender, ln(repeats) AS x, y FROM g WHERE repeats >= 2),"
    + _fe_sql("la", "f")
    + " SELECT feature, round(b * ln(2), 6) AS per_doubling, round(se * ln(2), 6) AS se FROM f",
    "bucket_tables": _G + " UNION ALL ".join(" (" + _bucket(n, e) + ")" for n, e in TABLES.items()),
    "template_profiles": f"""WITH h AS (SELECT source, md5({_TEMPLATE}) AS hash, len(regexp_extract_all(text, '\\S+')) AS w, n_chars FROM documents),
        per AS (SELECT hash, count(*) AS n, count(DISTINCT source) / count(*) AS ratio, sum(w) AS w, sum(n_chars) AS c FROM h GROUP BY 1 HAVING count(*) >= 2)
        SELECT CASE WHEN ratio <= 0.34 THEN 'many from few' WHEN ratio >= 0.9 THEN 'one from each' ELSE 'mixed' END AS kind, count(*) AS templates, max(n) AS most_copies,
               round(sum(w) / sum(n), 6) AS mean_words, round(sum(c) / sum(n), 6) AS mean_chars FROM per GROUP BY 1""",
}
