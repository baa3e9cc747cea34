"""Queries on the quality of labels. The labels' quality is one rating, a rule on the text the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.operators import agreement as ag
from tidewake.sources.tables import load


def _rated(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")
    clean = F.regexp_count("text", F.lit(r"[#*$%&|<>]")) * 50 < F.col("n_chars")
    grade = F.least(F.lit(4), F.floor(F.log10(F.col("n_chars") + 1))).cast("int")
    return d.select("doc_id", "lang", "source", "n_chars", (F.col("quality") == 1).alias("a"), clean.alias("b"), "quality", "toxic",
                    grade.alias("grade"), (F.col("quality") * 2 + F.col("toxic")).alias("score"), F.regexp_count("text", F.lit(r"\S+")).alias("n_words"))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def kappa_table(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ag.kappas(_rated(spark, sf), "lang", "a", "b"), "exact", "rate_a", "rate_b", "kappa")


def agreement_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ag.kappas(_rated(spark, sf), "source", "a", "b").select("source", "n", "left_out", "exact"), "exact")


def weighted_kappa(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ag.weighted_kappa(_rated(spark, sf), "grade", "score", 5), "kappa", "within_one", "signed")


def reliability_gate(spark: SparkSession, sf: str) -> DataFrame:
    all_ = _rated(spark, sf).withColumn("all", F.lit("all"))
    return _rounded(ag.gate(ag.kappas(all_, "all", "a", "b"), "kappa", 0.6, "quality"), "value")


def correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ag.correlations(_rated(spark, sf), ["n_chars", "n_words", "quality", "toxic"]), "r")


def cross_correlation(spark: SparkSession, sf: str) -> DataFrame:
    out = ag.correlations(_rated(spark, sf), ["quality", "toxic"], ["n_chars", "n_words", "grade"])
    return _rounded(out.withColumn("strong", F.abs("r") >= 0.35), "r")


def pc1_share(spark: SparkSession, sf: str) -> DataFrame:
    share, mean = ag.first_component(_rated(spark, sf), ["n_chars", "n_words", "quality", "toxic"])
    return _rounded(spark.createDataFrame([(share, mean, share >= 0.6 or mean >= 0.5)], "pc1_share double, mean_abs_r double, collapsed boolean"), "pc1_share", "mean_abs_r")


def _batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    sent = load(spark, sf, "documents").select(F.floor(F.col("doc_id") / 120).alias("batch"), F.col("doc_id").alias("id"))
    got = load(spark, sf, "labels").select(F.floor(F.col("doc_id") / 120).alias("batch"), F.col("doc_id").alias("id"), "quality", "toxic")
    return sent, got


def label_coverage(spark: SparkSession, sf: str) -> DataFrame:
    sent, got = _batches(spark, sf)
    return ag.coverage(sent, got, F.col("quality") + F.col("toxic") <= 1)


def label_invariants(spark: SparkSession, sf: str) -> DataFrame:
    sent, got = _batches(spark, sf)
    return ag.invariants(got, sent, {"quality": (0, 1), "toxic": (0, 0)})


def _first_pass(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") * 2 + F.col("toxic")).alias("label"))


def label_overlay(spark: SparkSession, sf: str) -> DataFrame:
    first = _first_pass(spark, sf)
    return ag.overlaid([first, first.where("id % 5 = 0").withColumn("label", F.col("label") + 10), first.where("id % 7 = 0").withColumn("label", F.col("label") + 20)])


def conditional_update(spark: SparkSession, sf: str) -> DataFrame:
    first = _first_pass(spark, sf)
    return ag.relabelled(first, first.where("id % 2 = 0").withColumn("label", F.lit(9)), F.col("label") == 2)


def label_impact(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose outcome (any toxic document) changes under the updated labels."""
    both = conditional_update(spark, sf).join(load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    per = both.groupBy("source").agg(F.bool_or(F.col("label_first") % 2 == 1).alias("before"), F.bool_or(F.col("label") % 2 == 1).alias("after"), F.count_if(F.col("label") != F.col("label_first")).alias("moved"))
    return per.withColumn("changed", F.col("before") != F.col("after"))


def score_distribution(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    counts = _rated(spark, sf).where("score IS NOT NULL").groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lang")), 6))


NAMES = (
    "kappa_table agreement_by_class weighted_kappa reliability_gate correlation_matrix cross_correlation pc1_share label_coverage label_invariants "
    "label_overlay conditional_update label_impact score_distribution"
).split()
QUERIES = {n: globals()[n] for n in NAMES}

_R = """WITH r AS (
    SELECT d.doc_id, lang, source, n_chars, quality = 1 AS a, len(regexp_extract_all(text, '[#*$%&|<>]')) * 50 < n_chars AS b, quality, toxic,
           least(4, CAST(floor(log10(n_chars + 1)) AS INTEGER)) AS grade, quality * 2 + toxic AS score, len(regexp_extract_all(text, '\\S+')) AS n_words
    FROM documents d LEFT JOIN labels l USING (doc_id))"""
_COUNTS = """count(*) FILTER (WHERE a IS NOT NULL) AS n, count(*) FILTER (WHERE a IS NULL) AS left_out, count(*) FILTER (WHERE a AND b) AS yy,
    count(*) FILTER (WHERE a) AS na, count(*) FILTER (WHERE a IS NOT NULL AND b) AS nb, count(*) FILTER (WHERE a = b) AS same"""
_KAPPA = """CASE WHEN (na / n) * (nb / n) + (1 - na / n) * (1 - nb / n) < 1 THEN
    ((n - na - nb + 2 * yy) / n - ((na / n) * (nb / n) + (1 - na / n) * (1 - nb / n))) / (1 - ((na / n) * (nb / n) + (1 - na / n) * (1 - nb / n))) END"""
_BATCHES = """WITH sent AS (SELECT doc_id // 120 AS batch, doc_id AS id FROM documents),
    got AS (SELECT doc_id // 120 AS batch, doc_id AS id, quality, toxic FROM labels)"""
_CONDITIONAL = "SELECT doc_id AS id, CASE WHEN quality * 2 + toxic = 2 AND doc_id % 2 = 0 THEN 9 ELSE quality * 2 + toxic END AS label, quality * 2 + toxic AS label_first FROM labels"


def _r(pairs: list[tuple[str, str]], more: str = "") -> str:
    return _R + " UNION ALL ".join(f" SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r{more.format(a=a, b=b)} FROM r" for a, b in pairs)


SQL = {
    "kappa_table": _R
    + f", c AS (SELECT lang, {_COUNTS} FROM r GROUP BY 1) SELECT lang, n, left_out, round(same / n, 6) AS exact, round(na / n, 6) AS rate_a, round(nb / n, 6) AS rate_b, round({_KAPPA}, 6) AS kappa FROM c",
    "agreement_by_class": _R + f", c AS (SELECT source, {_COUNTS} FROM r GROUP BY 1) SELECT source, n, left_out, round(same / n, 6) AS exact FROM c",
    "weighted_kappa": _R
    + """, s AS (SELECT count(*) AS n, avg((grade - score) * (grade - score)) AS seen, avg(grade) AS mx, avg(score) AS my, avg(grade * grade) AS xx, avg(score * score) AS yy,
                   avg(CASE WHEN abs(grade - score) <= 1 THEN 1.0 ELSE 0.0 END) AS w, avg(grade - score) AS d FROM r WHERE score IS NOT NULL)
          SELECT n, round(1 - seen / (xx - 2 * mx * my + yy), 6) AS kappa, round(w, 6) AS within_one, round(d, 6) AS signed, w >= 0.8 AND abs(d) <= 0.3 AS passes FROM s""",
    "reliability_gate": _R
    + f", c AS (SELECT {_COUNTS} FROM r) SELECT 'quality' AS gate, round({_KAPPA}, 6) AS value, CAST(0.6 AS DOUBLE) AS threshold, coalesce({_KAPPA} >= 0.6, false) AS passed FROM c",
    "correlation_matrix": _r([(a, b) for i, a in enumerate(c) for b in c[i + 1 :]] if (c := ["n_chars", "n_words", "quality", "toxic"]) else []),
    "cross_correlation": _r([(a, b) for a in ("quality", "toxic") for b in ("n_chars", "n_words", "grade")], ", abs(corr({a}, {b})) >= 0.35 AS strong"),
    # The largest eigenvalue of the correlation matrix by power iteration.
    "pc1_share": _R.replace("WITH r", "WITH RECURSIVE r")
    + """, c AS (SELECT corr(n_chars, n_words) AS ab, corr(n_chars, quality) AS ac, corr(n_chars, toxic) AS ad, corr(n_words, quality) AS bc, corr(n_words, toxic) AS bd, corr(quality, toxic) AS cd
                 FROM r WHERE quality IS NOT NULL AND toxic IS NOT NULL),
          step AS (
            SELECT 0 AS k, 1.0::DOUBLE AS a, 0.9::DOUBLE AS b, 0.3::DOUBLE AS c, 0.1::DOUBLE AS d, 1.0::DOUBLE AS size
            UNION ALL
            SELECT k + 1, a2 / s, b2 / s, c2 / s, d2 / s, s FROM (
                SELECT k, a2, b2, c2, d2, sqrt(a2 * a2 + b2 * b2 + c2 * c2 + d2 * d2) AS s FROM (
                    SELECT k, a + ab * b + ac * step.c + ad * d AS a2, ab * a + b + bc * step.c + bd * d AS b2, ac * a + bc * b + step.c + cd * d AS c2, ad * a + bd * b + cd * step.c + d AS d2
                    FROM step, c WHERE k < 400))),
          last AS (SELECT size / 4 AS share FROM step WHERE k = 400)
          SELECT round(share, 6) AS pc1_share, round((abs(ab) + abs(ac) + abs(ad) + abs(bc) + abs(bd) + abs(cd)) / 6, 6) AS mean_abs_r,
                 share >= 0.6 OR (abs(ab) + abs(ac) + abs(ad) + abs(bc) + abs(bd) + abs(cd)) / 6 >= 0.5 AS collapsed FROM last, c""",
    "label_coverage": _BATCHES
    + """, j AS (SELECT coalesce(s.batch, g.batch) AS batch, s.id AS s, g.id AS g, quality + toxic <= 1 AS legal FROM sent s FULL JOIN got g ON s.batch = g.batch AND s.id = g.id),
          c AS (SELECT batch, count(s) AS sent, count(g) AS got, count(*) FILTER (WHERE g IS NULL) AS missing, count(*) FILTER (WHERE s IS NULL) AS extra,
                       count(*) FILTER (WHERE NOT legal) AS illegal FROM j GROUP BY 1)
          SELECT *, missing + extra + illegal > 0 AS rerun FROM c""",
    "label_invariants": _BATCHES
    + """ SELECT 'missing' AS "check", count(*) AS n_bad FROM sent WHERE id NOT IN (SELECT id FROM got)
          UNION ALL SELECT 'extra', count(*) FROM got WHERE id NOT IN (SELECT id FROM sent)
          UNION ALL SELECT 'repeated', count(*) FROM (SELECT id FROM got GROUP BY 1 HAVING count(*) > 1)
          UNION ALL SELECT 'range of quality', count(*) FILTER (WHERE quality NOT BETWEEN 0 AND 1) FROM got
          UNION ALL SELECT 'range of toxic', count(*) FILTER (WHERE toxic NOT BETWEEN 0 AND 0) FROM got""",
    "label_overlay": "SELECT doc_id AS id, quality * 2 + toxic + CASE WHEN doc_id % 7 = 0 THEN 20 WHEN doc_id % 5 = 0 THEN 10 ELSE 0 END AS label FROM labels",
    "conditional_update": _CONDITIONAL,
    "label_impact": f"""WITH u AS ({_CONDITIONAL}), per AS (
            SELECT source, bool_or(label_first % 2 = 1) AS before, bool_or(label % 2 = 1) AS after, count(*) FILTER (WHERE label <> label_first) AS moved
            FROM u JOIN documents ON doc_id = id GROUP BY 1)
        SELECT *, before <> after AS changed FROM per""",
    "score_distribution": _R + ", c AS (SELECT lang, score, count(*) AS n FROM r WHERE score IS NOT NULL GROUP BY 1, 2) SELECT lang, score, n, round(n / sum(n) OVER (PARTITION BY lang), 6) AS share FROM c",
}
