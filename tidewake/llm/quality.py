"""Quality rules: text statistics, a base rule, and a decision list learned from labelled statistics.

Everything runs as DataFrame expressions. The learner is sequential covering: a rule is a conjunction
of thresholds, grown on two thirds of the labelled rows by information gain, pruned on the other third
and kept while it is precise there; rows that it covers leave, and the next rule is grown. Each step
asks Spark for one small table of counts by (statistic, bin). The result is an ordered conditional
expression over the statistics.

Cases: a null or empty text has no words and fails the base rule; extra columns of the input never
enter (only ``doc_id`` and ``text`` are read); repeated rows each get their own result; no labels, or
labels of one class alone, give an empty list that keeps what passes the base rule; label rows whose
class is null are left out; texts of any length are judged whole, as one row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.llm.shared import as_row, written

#: Characters that separate words: space, tab, LF, VT, FF, CR.
SPACES = " \t\n\x0b\x0c\r"
SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: What the rules may test: name -> expression over the statistics.
FEATURES = {
    "symbol_rate": "n_symbols / greatest(word_chars, 1)",
    "upper_rate": "n_upper / greatest(word_chars, 1)",
    "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)",
    "distinct_rate": "n_distinct_words / greatest(n_words, 1)",
    "mean_word": "word_chars / greatest(n_words, 1)",
    "words": "double(n_words)",
}


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text, one row per input row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).withColumn("trimmed", F.expr(f"btrim(text, {_literal(SPACES)})"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    base = base.withColumns({"words": F.split("trimmed", SPLIT, -1), "lines": lines})
    base = base.select(
        "doc_id",
        "words",
        F.when(F.col("trimmed") == "", F.lit(0)).otherwise(F.size("words")).cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("trimmed") == "", F.lit(0)).otherwise(F.size(F.array_distinct("words"))).cast("long").alias("n_distinct_words"),
    )
    base = base.withColumn("words", F.transform("words", lambda w: F.xxhash64(w)))
    # Windows of five words as (hash, place), sorted so that equal windows of a text stand together.
    window = F.expr(
        f"""CASE WHEN n_words < {WINDOW} THEN CAST(array() AS array<struct<h: bigint, i: int>>)
        ELSE sort_array(transform(sequence(1, CAST(n_words AS int) - {WINDOW - 1}),
             i -> named_struct('h', xxhash64({", ".join(f"words[i + {k}]" for k in range(-1, WINDOW - 1))}), 'i', i))) END"""
    )
    base = base.withColumn("windows", window).drop("words")
    twice = F.expr(
        """sort_array(transform(filter(windows, (x, j) -> coalesce(get(windows, j - 1).h = x.h, false)
             OR coalesce(get(windows, j + 1).h = x.h, false)), x -> x.i))"""
    )
    base = base.withColumn("places", twice).drop("windows")
    covered = F.expr(
        f"""aggregate(places, named_struct('total', 0L, 'last', -{WINDOW}),
             (a, p) -> named_struct('total', a.total + least({WINDOW}, p - a.last), 'last', p), a -> a.total)"""
    )
    base = base.withColumn("n_repeat_words", covered).drop("places")
    # A generator, through which no filter is pushed: a filter on a statistic would otherwise be
    # rewritten over the arrays above and work them out again inside their own lambdas.
    return base.select("doc_id", F.inline(F.array(F.struct(*[c for c in base.columns if c != "doc_id"]))))


def _literal(text: str) -> str:
    return "'" + "".join(f"\\u{ord(c):04x}" for c in text) + "'"


def base_failed() -> Column:
    """Too few words, or too many of them in repeated windows."""
    return F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass
class DecisionList:
    """Rules in order; the first that holds rejects a row, and a row that none covers is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def expression(self) -> Column:
        kept: Column | None = None
        for rule in self.rules:
            holds = F.expr(" AND ".join(c.sql() for c in rule))
            kept = F.when(holds, F.lit(False)) if kept is None else kept.when(holds, F.lit(False))
        return F.lit(True) if kept is None else kept.otherwise(F.lit(True))


def labelled_sample(labels: DataFrame, label: str, bound: int) -> DataFrame:
    """At most ``bound`` label rows, the first in the order of a hash of doc_id, so that they can be broadcast."""
    rows = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).where("_id IS NOT NULL AND _label IS NOT NULL")
    n = rows.count()
    if n <= bound:
        return rows
    # Well over the bound are let through before they are ordered; the hash is the same in both steps.
    rows = rows.withColumn("_order", F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 40)))
    return rows.where(F.col("_order") <= int(min(1.0, 1.2 * bound / n) * (1 << 40))).orderBy("_order", "_id", "_label").limit(bound).drop("_order")


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    labelled_rows: int = 20_000,
    bins: int = 40,
    max_rules: int = 8,
    max_conditions: int = 3,
    min_precision: float = 0.9,
    min_share: float = 0.01,
) -> DecisionList:
    """The decision list that tells ``label`` 0 from 1 among documents that pass the base rule.

    ``labelled_rows`` bounds the labelled documents that are looked at; the learner's counts are over
    all of those. A rule must cover ``min_share`` of the class, and be right for ``min_precision`` of
    the rows that it covers in the pruning third.
    """
    picked = labelled_sample(labels, label, labelled_rows)
    docs = docs.select("doc_id", "text")
    known = docs.join(F.broadcast(picked), docs["doc_id"] == picked["_id"], "inner").select(docs["doc_id"], docs["text"], "_label")
    stats = statistics(known.select(F.struct("doc_id", "_label").alias("doc_id"), "text"))
    stats = stats.where(~base_failed()).select(
        (F.col("doc_id._label") == 0).alias("low"),
        (F.pmod(F.xxhash64("doc_id.doc_id", F.lit("prune")), F.lit(3)) == 0).alias("prune"),
        *[F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()],
    )
    stats = written(stats, "quality-labelled")
    names = list(FEATURES)
    cuts = stats.agg(*[F.percentile_approx(n, [i / bins for i in range(1, bins)], 10_000).alias(n) for n in names]).first()
    edges = {n: _with_middles(sorted({float(x) for x in cuts[n] or ()})) for n in names}
    binned = stats.select(
        "low", "prune", *names,
        F.array(*[F.expr(" + ".join(f"int({n} > {x!r}D)" for x in edges[n]) or "0") for n in names]).alias("bins"),
    )
    binned = written(binned, "quality-bins")
    total = binned.where("NOT prune AND low").count()
    found = DecisionList()
    left = F.lit(True)
    while total and len(found.rules) < max_rules:
        rule = _grow(binned.where(left & ~F.col("prune")), names, edges, max_conditions, max(5, min_share * total))
        rule = _prune(binned.where(left & F.col("prune")), rule, min_precision) if rule else None
        if not rule:
            break
        found.rules.append(rule)
        left = left & ~_holds(rule)
    return found


def _with_middles(cuts: list[float]) -> list[float]:
    return sorted({*cuts, *((a + b) / 2 for a, b in zip(cuts, cuts[1:], strict=False))})


def _holds(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & ((F.col(c.feature) > c.threshold) if c.above else (F.col(c.feature) <= c.threshold))
    return out


def _grow(rows: DataFrame, names: list[str], edges: dict[str, list[float]], most: int, least: float) -> list[Condition]:
    rule: list[Condition] = []
    while len(rule) < most:
        counts = (
            rows.where(_holds(rule)).select("low", F.posexplode("bins").alias("f", "bin"))
            .groupBy("f", "bin").agg(F.count_if("low").alias("p"), F.count_if(~F.col("low")).alias("n")).collect()
        )
        tally = {(r["f"], r["bin"]): (r["p"], r["n"]) for r in counts}
        p0, n0 = (sum(x[k] for (f, _), x in tally.items() if f == 0) for k in (0, 1))
        if not p0 or not n0:
            break
        best, gain = None, 1e-9
        for f, name in enumerate(names):
            p = n = 0
            for b, edge in enumerate(edges[name]):
                dp, dn = tally.get((f, b), (0, 0))
                p, n = p + dp, n + dn
                for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                    if pp >= least:
                        g = pp * (math.log2(pp / (pp + nn)) - math.log2(p0 / (p0 + n0)))
                        # Of thresholds that cover the same rows, the one that rejects least elsewhere.
                        same = best == Condition(name, above, last) if best and b else False
                        if g > gain or (above and same and g == gain):
                            best, gain = Condition(name, above, edge), g
                last = edge
        if best is None:
            break
        rule.append(best)
    return rule


def _prune(rows: DataFrame, rule: list[Condition], least: float) -> list[Condition] | None:
    """The prefix of the rule that does best on rows it has not seen, or None."""
    parts = [rule[:k] for k in range(1, len(rule) + 1)]
    got = rows.agg(
        *[F.count_if(_holds(r) & F.col("low")).alias(f"p{k}") for k, r in enumerate(parts)],
        *[F.count_if(_holds(r) & ~F.col("low")).alias(f"n{k}") for k, r in enumerate(parts)],
    ).first()
    score = [((got[f"p{k}"] - got[f"n{k}"]) / (got[f"p{k}"] + got[f"n{k}"]) if got[f"p{k}"] else -1.0, -k) for k in range(len(parts))]
    value, k = max(score)
    return parts[-k] if (1 + value) / 2 >= least else None


def judged(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """The statistics of every document with ``base_failed`` and ``kept``."""
    stats = statistics(docs).withColumn("base_failed", base_failed())
    return stats.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(rules.expression()))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that base rule and decision list keep, with all their columns."""
    rules = learn(docs, labels)
    # The row rides through as a struct in the place of its id.
    held = docs.select(as_row(docs).alias("doc_id"), "text")
    return judged(held, rules).where("kept").select("doc_id.*")
