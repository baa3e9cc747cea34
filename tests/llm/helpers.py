"""Small tables and brute-force twins for the tests of this folder."""

import hashlib
import re
import zlib

SPACES = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in SPACES.split(text or "") if w]


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def crc(data):
    return zlib.crc32(data)


def docs(spark, rows):
    """A documents table of (doc_id, text) rows."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def clashing(df):
    """The same rows with more columns, named as the operators name theirs."""
    from pyspark.sql import functions as F

    for name in ("id", "row", "part", "start", "length", "spans", "n", "print", "words", "kept", "label", "bands", "ids", "_id", "_label"):
        df = df.withColumn(name, F.lit(7))
    return df


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
