"""The operators as registered queries: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_text, line_dedup, packing, piece_bpe, quotes, resampling, simhash, spelling, token_binary, token_counts, topk_search, toxicity
from .common import table


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return marks.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return marks.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.token_shards(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_documents(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op")}


ORACLES = {
    "op1_quotation_linking": """
        WITH RECURSIVE rows AS (
            SELECT conv_id, turn, role, string_split_regex(coalesce(text, ''), '\r\n|\r|\n') AS lines FROM conversations
        ), messages AS (
            SELECT conv_id, turn, role, lines, array_to_string(list_transform(list_filter(marked, lambda m: m.stays), lambda m: m.line), chr(10)) AS own
            FROM (SELECT *, list_transform(lines, lambda x, i: {
                             'stays': CASE WHEN regexp_matches(x, '^[ \t]{0,3}>') THEN NOT coalesce(regexp_matches(lines[i + 1], '^[ \t]{0,3}>'), false)
                                      ELSE NOT (regexp_matches(x, '^On .* wrote:[ \t]*$') AND coalesce(regexp_matches(lines[i + 1], '^[ \t]{0,3}>'), false)) END,
                             'line': CASE WHEN regexp_matches(x, '^[ \t]{0,3}>') THEN '' ELSE x END}) AS marked FROM rows)
        ), named AS (
            SELECT * FROM messages WHERE conv_id IS NOT NULL AND turn IS NOT NULL
        ), originals AS (
            SELECT conv_id, part, min(turn) AS origin
            FROM (SELECT conv_id, turn, trim(regexp_replace(lower(part), '[ \t\r\n]+', ' ', 'g')) AS part
                  FROM (SELECT conv_id, turn, unnest(string_split_regex(own, '\n[ \t]*\n')) AS part FROM named))
            WHERE part <> '' GROUP BY ALL
        ), texts AS (
            SELECT conv_id, turn, list_filter(list_transform(string_split(own, chr(10)), lambda x: trim(regexp_replace(lower(x), '[ \t\r\n]+', ' ', 'g'))), lambda x: x <> '') AS has
            FROM named
        ), numbered AS (
            SELECT conv_id, turn, lines AS copy, unnest(range(len(lines))) AS n, unnest(lines) AS line
            FROM (SELECT DISTINCT conv_id, turn, lines FROM named)
        ), quoted AS (
            SELECT *, n - row_number() OVER (PARTITION BY conv_id, turn, copy, level ORDER BY n) AS run
            FROM (SELECT conv_id, turn, copy, n,
                         length(regexp_replace(regexp_extract(line, '^[ \t]{0,3}>(?:[ \t]?>)*'), '[^>]', '', 'g')) AS level,
                         trim(regexp_replace(lower(regexp_replace(line, '^[ \t]{0,3}>(?:[ \t]?>)*', '')), '[ \t\r\n]+', ' ', 'g')) AS line
                  FROM numbered)
            WHERE level > 0 AND line <> ''
        ), whole AS (
            SELECT conv_id, turn, copy, level, run, string_agg(line, ' ' ORDER BY n) AS part, list(line ORDER BY n) AS want FROM quoted GROUP BY conv_id, turn, copy, level, run
        ), by_passage AS (
            SELECT w.conv_id, w.turn, w.copy, w.level, w.run, origin FROM whole w
            JOIN originals o ON o.conv_id = w.conv_id AND o.part = w.part AND origin < turn
        ), by_line AS (
            -- The lines of the passage, in their order, among those of an earlier message: walk through the message and
            -- count, as text, how many of the wanted ones have come.
            SELECT w.conv_id, w.turn, w.copy, w.level, w.run, min(t.turn) AS origin
            FROM whole w JOIN texts t ON t.conv_id = w.conv_id AND t.turn < w.turn
            WHERE CAST(list_reduce(list_concat(['0'], t.has), lambda seen, x: CASE WHEN w.want[CAST(seen AS INTEGER) + 1] = x THEN CAST(CAST(seen AS INTEGER) + 1 AS VARCHAR) ELSE seen END) AS INTEGER) = len(w.want)
            GROUP BY w.conv_id, w.turn, w.copy, w.level, w.run
        ), links AS (
            SELECT w.conv_id, w.turn, count(*) AS n_quotes, count(coalesce(p.origin, l.origin)) AS n_linked,
                   coalesce(max(coalesce(p.origin, l.origin)) FILTER (w.level = 1), max(coalesce(p.origin, l.origin))) AS reply_to
            FROM whole w LEFT JOIN by_passage p USING (conv_id, turn, copy, level, run)
            LEFT JOIN by_line l USING (conv_id, turn, copy, level, run) GROUP BY w.conv_id, w.turn
        ), climb AS (
            SELECT conv_id, turn, reply_to AS thread_root, CAST(1 AS BIGINT) AS depth FROM links WHERE reply_to IS NOT NULL
            UNION ALL
            SELECT c.conv_id, c.turn, l.reply_to, c.depth + 1 FROM climb c JOIN links l ON l.conv_id = c.conv_id AND l.turn = c.thread_root
            WHERE l.reply_to IS NOT NULL
        ), threads AS (
            SELECT conv_id, turn, arg_max(thread_root, depth) AS thread_root, max(depth) AS depth FROM climb GROUP BY ALL
        )
        SELECT m.conv_id, m.turn, m.role, trim(regexp_replace(own, '^\n+|\n+$', '', 'g')) AS text,
               coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, l.reply_to,
               coalesce(t.thread_root, m.turn) AS thread_root, coalesce(t.depth, 0) AS depth
        FROM messages m LEFT JOIN links l ON l.conv_id = m.conv_id AND l.turn = m.turn
        LEFT JOIN threads t ON t.conv_id = m.conv_id AND t.turn = m.turn
    """,
    "op2_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM scored QUALIFY rank <= 10
    """,
    "op7_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER g AS keep_id,
               count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op13_line_dedup": """
        WITH texts AS (
            SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), rows AS (
            SELECT doc_id, r, unnest(range(len(lines))) AS place, unnest(lines) AS line FROM texts
        ), keyed AS (
            SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM rows
        ), shared AS (
            SELECT key, min(doc_id) AS first_id FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
        ), marked AS (
            SELECT k.*, coalesce(k.doc_id <> s.first_id, false) AS goes FROM keyed k LEFT JOIN shared s USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT goes), '')) AS kept_sha256
        FROM marked GROUP BY doc_id, r
    """,
}
