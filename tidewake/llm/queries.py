"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewake.llm import chat, codec, fim, idfile, jaccard, lines, media, packing, quality, spelling, substring, toxicity, warc
from tidewake.llm.shared import small_batches, table


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.read(idfile.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicated(table(spark, sf_dir, "documents"))
    return found.select("row.doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality.learn(docs, table(spark, sf_dir, "labels"))
    return quality.judged(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(media.stored(table(spark, sf_dir, "documents")))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    small_batches(spark)
    return codec.digests(codec.encode(table(spark, sf_dir, "documents"), path), path)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    said = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat.read_back(chat.formatted(rows, path), path)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_rows(warc.records(spark, warc.archived(table(spark, sf_dir, "pages"))))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transformed(fim.stored(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_token_ids": op4_token_ids,
    "op5_line_dedup": op5_line_dedup,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_media_columns": op7_media_columns,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_warc": op11_warc,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_fill_in_middle": op13_fill_in_middle,
}



def _crc_table() -> list[int]:
    """The 256 remainders of CRC-32, by its polynomial (a fixed value, its bits reversed)."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


SQL: dict[str, str] = {
    "op5_line_dedup": r"""
        WITH pieces AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS k
            FROM documents),
        solid AS (
            SELECT doc_id, line, k, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n,
                   len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
            FROM pieces WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        following AS (
            SELECT doc_id, n, line, words, lead(line, 1) OVER w AS line_2, lead(line, 2) OVER w AS line_3, lead(words, 1) OVER w AS words_2
            FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
        runs AS (
            SELECT doc_id, n, 3 AS size, line || chr(10) || line_2 || chr(10) || line_3 AS run FROM following
            UNION ALL SELECT doc_id, n, 2, line || chr(10) || line_2 FROM following WHERE words + words_2 >= 50
            UNION ALL SELECT doc_id, n, 1, line FROM following WHERE words >= 50),
        late AS (
            SELECT doc_id, n, size FROM (
                SELECT doc_id, n, size, row_number() OVER (PARTITION BY size, run ORDER BY doc_id, n) AS nth FROM runs WHERE run IS NOT NULL)
            WHERE nth > 1),
        gone AS (SELECT DISTINCT doc_id, n + j AS n FROM late, range(3) AS t(j) WHERE j < size),
        marked AS (
            SELECT p.doc_id, p.k, p.line, s.n IS NOT NULL AS is_solid, g.n IS NOT NULL AS is_gone
            FROM pieces p LEFT JOIN solid s USING (doc_id, k) LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.n = s.n)
        SELECT doc_id, count(*) FILTER (WHERE is_solid) AS n_lines, count(*) FILTER (WHERE is_gone) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT is_gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op11_warc": """
        WITH raw AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        summed AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY sha1(html)) AS latest FROM raw),
        nibbles AS (SELECT *, list_transform(range(1, 41), lambda k: strpos('0123456789abcdef', substr(hex, k, 1)) - 1) AS half FROM summed)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
                   (((half[5 * k // 4 + 1] * 16 + half[5 * k // 4 + 2]) >> (3 - 5 * k % 4)) & 31)::BIGINT, 1)), '') AS payload_digest,
               CASE WHEN page_id IS NOT DISTINCT FROM latest THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM latest THEN latest END AS refers_to
        FROM nibbles""",
    "op13_fill_in_middle": """
        WITH raw AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, 'null')) AS hex FROM documents),
        cut AS (
            SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
                   ('0x' || hex[1:8])::UBIGINT AS h1, ('0x' || hex[9:16])::UBIGINT AS h2,
                   ('0x' || hex[17:24])::UBIGINT AS h3, ('0x' || hex[25:32])::UBIGINT AS h4
            FROM raw),
        placed AS (
            SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS a,
                   greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM cut),
        parts AS (
            SELECT doc_id, n, form, text, array_to_string(list_slice(units, 1, a), '') AS prefix,
                   array_to_string(list_slice(units, a + 1, b), '') AS middle, array_to_string(list_slice(units, b + 1, n), '') AS suffix
            FROM placed)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts""",
    "op12_spelling_variants": f"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
        per AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY 1, 2),
        raw AS (
            SELECT run, k, flatten(list_transform(regexp_extract_all(coalesce(doc_id::VARCHAR, 'null') || ':' || run, '.'),
                       lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS bytes FROM per),
        hashed AS (
            SELECT run, k, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes),
                       lambda c, b: xor(c >> 8, ({_crc_table()}::BIGINT[])[1 + (xor(c, b) & 255)])), 4294967295::BIGINT) AS h FROM raw),
        changed AS (
            SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM hashed),
        words AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM changed WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
        places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
        wild AS (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS pattern FROM places),
        less AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS shorter FROM places),
        pairs AS (
            SELECT a.word, b.word AS near, b.n AS near_n FROM wild a JOIN wild b ON a.pattern = b.pattern AND a.word <> b.word
            UNION ALL SELECT less.word, words.word, words.n FROM less JOIN words ON words.word = shorter
            UNION ALL SELECT words.word, less.word, less.n FROM less JOIN words ON words.word = shorter),
        best AS (
            SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, encode(near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY 1),
        formed AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
            FROM words LEFT JOIN best USING (word)),
        chain AS (
            SELECT word, word AS at_word, form AS next_word FROM formed
            UNION ALL SELECT chain.word, formed.word, formed.form FROM chain JOIN formed ON formed.word = next_word)
        SELECT formed.word, form, at_word AS root, n, n_near, form_n FROM formed JOIN chain ON chain.word = formed.word AND next_word IS NULL""",
}
