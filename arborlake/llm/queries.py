"""One query per operator, with production parameters over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from arborlake.llm.bpe import encoding_digests

    return encoding_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.llm.ann import search

    return search(_table(spark, sf_dir, "embeddings"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.llm.ngram_join import link

    return link(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.llm.quality import judge

    return judge(_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.llm.license_scan import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.llm.lang_id import identify, train

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).drop("shares")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from arborlake.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits an archive of all pages against a damaged replica.

    By their id modulo 50, pages of 7 lost their first '<p>', those of 3 are
    missing, and those of 11 are there once more under a new id.
    """
    from arborlake.llm.warc import audit_pages

    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    kind = F.pmod("page_id", F.lit(50))
    damaged = F.when(kind == 7, F.regexp_replace("html", "(?s)^(.*?)<p>", "$1<q>")).otherwise(F.col("html"))
    whole = pages.filter((kind != 3) | F.col("page_id").isNull()).withColumn("html", damaged)
    return audit_pages(pages, whole.union(pages.filter(kind == 11).withColumn("page_id", F.col("page_id") + 1_000_000_000_000)))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.llm.html_extract import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from arborlake.llm.chat import format_chat

    return format_chat(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_bpe, op2_nearest, op3_ngram_join, op4_quality, op5_licenses, op6_language, op7_packing, op8_warc_audit, op9_main_text, op10_chat)}

ORACLE_SQL: dict[str, str] = {
    # op2_nearest: SQL engines sum inner products in another order, which shows in the last digit; tests hold it against brute force
    "op4_quality": r"""
        WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT i, unnest(ws) AS w, generate_subscripts(ws, 1) AS k, len(ws) AS n FROM (SELECT i, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS ws FROM d)),
        c AS (SELECT i, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (regexp_matches(w, '[A-Za-z]|[^\x00-\x7F]')) AS lettered FROM w GROUP BY i),
        g AS (SELECT i, k, CASE WHEN k + 4 <= n THEN w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o END AS gram FROM w WINDOW o AS (PARTITION BY i ORDER BY k)),
        r AS (SELECT i, k, gram IS NOT NULL AND count(*) OVER (PARTITION BY i, gram) > 1 AS hit FROM g),
        s AS (SELECT i, k, bool_or(hit) OVER (PARTITION BY i ORDER BY k ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS covered FROM r),
        p AS (SELECT i, count(*) FILTER (covered) AS n_repeat_words FROM s GROUP BY i),
        l AS (SELECT i, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT i, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]') GROUP BY i),
        m AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
                coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(lettered, 0) AS lettered, length(regexp_replace(text, '[^!]', '', 'g')) AS shouts, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters,
                length(regexp_replace(text, '[^\n]', '', 'g')) + 1 AS lines FROM d LEFT JOIN c USING (i) LEFT JOIN p USING (i) LEFT JOIN l USING (i)),
        b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
        v AS (SELECT *, CASE WHEN base_failed THEN NULL WHEN 10 * n_symbols > 3 * n_words THEN 'symbols' WHEN 2 * shouts > n_words THEN 'exclamations' WHEN up > 20 AND 2 * up > letters THEN 'upper_case' WHEN 2 * n_dup_lines > lines THEN 'dup_lines' WHEN 2 * lettered < n_words THEN 'letters' END AS rejected_by FROM b)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by IS NULL AS kept, rejected_by FROM v""",
    "op8_warc_audit": """
        WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, false AS new FROM pages UNION ALL SELECT page_id + 1000000000000, coalesce(url, ''), coalesce(html, ''), true FROM pages WHERE page_id % 50 = 11),
        r AS (SELECT page_id, html, new, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10)
                || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM p),
        h AS (SELECT page_id, html, new, strlen(rec)::BIGINT AS n_bytes, sha256(rec) AS record_sha256, floor(coalesce(page_id, 0) / 256)::BIGINT AS file_id FROM r)
        SELECT page_id, file_id, 0::BIGINT AS part, (row_number() OVER w - 1)::BIGINT AS place, (sum(n_bytes) OVER w - n_bytes)::BIGINT AS first_byte, n_bytes, record_sha256,
               CASE WHEN new THEN 'extra' WHEN page_id % 50 = 3 THEN 'missing' WHEN page_id % 50 = 7 AND contains(html, '<p>') THEN 'changed' ELSE 'intact' END AS status
        FROM h WINDOW w AS (PARTITION BY file_id ORDER BY page_id NULLS FIRST, record_sha256 ROWS UNBOUNDED PRECEDING)""",
    "op10_chat": r"""
        WITH RECURSIVE m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
        l AS (SELECT conv_id, turn, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM (SELECT DISTINCT conv_id, turn, text FROM m)),
        s AS (SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]*)*)', 1), '[^>]', '', 'g')) AS level,
                trim(regexp_replace(lower(regexp_replace(line, '^[ \t]*((?:>[ \t]*)*)', '')), '[ \t\r\f\x0B]+', ' ', 'g')) AS said FROM l),
        v AS (SELECT *, lag(level) OVER w AS prev, lead(line) OVER w AS after FROM s WINDOW w AS (PARTITION BY conv_id, turn, text ORDER BY i)),
        r AS (SELECT *, count(*) FILTER (prev IS NULL OR level <> prev) OVER (PARTITION BY conv_id, turn, text ORDER BY i) AS run FROM v),
        g AS (SELECT conv_id, turn, level, 0 AS kind, string_agg(said, ' ' ORDER BY i) FILTER (said <> '') AS said FROM r GROUP BY conv_id, turn, text, run, level
              UNION ALL SELECT conv_id, turn, level, 1, said FROM r WHERE len(string_split(said, ' ')) >= 3),
        u AS (SELECT DISTINCT * FROM g WHERE said <> ''),
        q AS (SELECT a.conv_id, a.turn, a.level, a.kind, a.said, max(b.turn) AS source FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.kind = b.kind AND a.said = b.said AND a.level = b.level + 1 AND b.turn < a.turn GROUP BY ALL),
        c AS (SELECT conv_id, turn, source, count(*) FILTER (kind = 0) AS p, count(*) AS n FROM q GROUP BY ALL),
        k AS (SELECT conv_id, turn, source, n, row_number() OVER (PARTITION BY conv_id, turn ORDER BY p DESC, n DESC, source DESC) AS r FROM c),
        d AS (SELECT DISTINCT conv_id, turn FROM m),
        e AS (SELECT d.conv_id, d.turn, coalesce(k.source, b.turn) AS reply_to, coalesce(k.n, 0)::BIGINT AS n_linked FROM d LEFT JOIN k ON k.conv_id = d.conv_id AND k.turn = d.turn AND k.r = 1 LEFT JOIN d b ON b.conv_id = d.conv_id AND b.turn = d.turn - 1),
        h AS (SELECT conv_id, turn, turn AS thread, 0::BIGINT AS depth, [turn] AS path FROM e WHERE reply_to IS NULL
              UNION ALL SELECT e.conv_id, e.turn, h.thread, h.depth + 1, list_append(h.path, e.turn) FROM e JOIN h ON e.conv_id = h.conv_id AND e.reply_to = h.turn),
        o AS (SELECT conv_id, turn, thread, depth, (row_number() OVER (PARTITION BY conv_id, thread ORDER BY path) - 1)::BIGINT AS position FROM h),
        t AS (SELECT conv_id, turn, text, string_agg(line, chr(10) ORDER BY i) FILTER (level = 0 AND NOT (regexp_matches(line, '(?i)^\s*(on\s.*\swrote|.*\swrote|am\s.*\sschrieb.*|le\s.*\sa écrit|el\s.*\sescribió)\s*:\s*$') AND coalesce(regexp_matches(after, '^[ \t]*>'), false))) AS plain FROM v GROUP BY conv_id, turn, text),
        z AS (SELECT m.*, regexp_replace(coalesce(t.plain, ''), '^\s+|\s+$', '', 'g') AS content FROM m JOIN t USING (conv_id, turn, text))
        SELECT z.conv_id, z.turn, z.role, e.reply_to, e.n_linked, o.thread, o.depth, o.position, z.content, '<|' || z.role || '|>' || chr(10) || z.content || chr(10) || '<|end|>' AS formatted
        FROM z JOIN e USING (conv_id, turn) JOIN o USING (conv_id, turn)""",
}
