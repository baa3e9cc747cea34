"""A corpus pipeline of five operators, each stage over all rows that the one before kept.

Quality rules reject documents; line dedup and substring dedup shorten texts, and drop documents that they leave
without a word; of each class of near duplicates one row of least doc_id stays; packing
turns what is left into token sequences. Every stage is written as Parquet and read again; what it read and wrote on the way
is deleted then, so that the disk holds one stage at a time.

Cases: a null or empty text fails the quality rules, and is left as it is by the stages after (near duplicates keep all
documents without a word, since those stand alone); a null doc_id counts as the largest one; repeated rows are judged
alike by the stages on texts, and near duplicates keep one of them; ties go to the least doc_id, then to the text of least
hash; texts of any length are taken whole; columns beyond those of documents ride along, whatever their names; an empty
table gives an empty result at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import jaccard, lines, packing, quality, substring
from tidewake.llm.shared import drop_paths, noted, quoted, table, written

#: A word n-gram is five words here, and near duplicates share four fifths of theirs.
SHINGLE, SHARE = 5, (80, 100)


def _shortened(found: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with their kept texts; a document that loses its last word goes."""
    changed = F.col("n_removed") > 0

    def column(name: str) -> Column:
        old = F.col(f"row.{quoted(name)}")
        new = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}.get(name)
        return (old if new is None else F.when(changed, new).otherwise(old)).alias(name)

    left = F.btrim("kept", F.lit(quality.SPACES)) != ""
    return found.where(~changed | left).select(*map(column, columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _shortened(lines.deduplicated(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.heads(docs, SHINGLE, *SHARE)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _shortened(substring.deduplicated(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_duplicates),
    ("substring dedup", substring_dedup),
    ("packing", pack),
]

#: Learned rules and tokens are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with noted() as paths:
            docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        drop_paths(spark, before + paths[:-1])
        before = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
