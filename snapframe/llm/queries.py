"""The corpus operators applied to whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snapframe.llm import bpe, grace_dedup, html_extract, language_id, ngram_join, ordinal_quality, packing, prefix_trie, quality_rules, source_mix, toxicity, unit_dedup, whitening
from snapframe.session import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.cluster(table(spark, sf_dir, "documents"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", F.round("first_time", 9).alias("first_time"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_documents(table(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


def op6_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.repeated_passages(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal_quality.grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grace_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_ngram_join,
        op3_source_mix,
        op4_language_id,
        op5_html_extract,
        op6_unit_dedup,
        op7_toxicity,
        op8_bpe,
        op9_ordinal_quality,
        op10_grace_dedup,
        op11_embedding_whitening,
        op12_best_fit_packing,
        op13_prefix_trie,
    )
}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op10_grace_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
        FROM d JOIN g USING (norm)""",
    "op13_prefix_trie": r"""
        WITH t AS (
            SELECT conv_id, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code, turn
            FROM conversations WHERE conv_id IS NOT NULL),
        p AS (SELECT conv_id, code, octet_length(encode(text)) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, code) AS place FROM t),
        c AS (
            SELECT conv_id, conv_id - conv_id % 5 AS base,
                   xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                       lambda crc, b: list_reduce(range(8), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, xor(crc, b)),
                       CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % 9 AS h
            FROM (SELECT DISTINCT conv_id FROM p)),
        r AS (
            SELECT c.conv_id, p.place, p.code, p.size FROM c JOIN p ON p.conv_id = c.base AND p.place <= c.h
            UNION ALL SELECT c.conv_id, p.place, p.code, p.size FROM c JOIN p ON p.conv_id = c.conv_id AND p.place > c.h),
        q AS (
            SELECT conv_id, 0 AS depth, [] AS path, 0 AS size FROM c
            UNION ALL SELECT conv_id, row_number() OVER w AS depth, list(code) OVER w AS path, size FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY place ROWS UNBOUNDED PRECEDING)),
        m AS (SELECT conv_id, max(depth) AS turns FROM q GROUP BY conv_id),
        n AS (
            SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = turns), '')) AS ends_sha256
            FROM q JOIN m USING (conv_id) GROUP BY path, depth),
        k AS (SELECT path[:-2] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
        a AS (
            SELECT q.path, count(*) FILTER (WHERE k.path IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.size) AS saved_tokens
            FROM n JOIN q ON q.conv_id = n.conv_id AND q.depth <= n.depth LEFT JOIN k ON k.path = n.path GROUP BY q.path)
        SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, a.n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
        FROM n JOIN a USING (path) LEFT JOIN k ON k.path = n.path LEFT JOIN n u ON n.depth > 0 AND u.path = n.path[:-2]""",
    "op3_source_mix": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS shuffle
            FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
        w AS (
            SELECT *, [5, 2, 1][CAST(rank % 3 + 1 AS INT)] AS weight, [0.5, 0.0, -0.5][CAST(rank % 3 + 1 AS INT)]::DOUBLE AS ramp, source_size * 2 AS cap
            FROM r),
        l AS (
            SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                   / (sum(weight) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS own
            FROM w WINDOW b AS (ORDER BY cap / weight, rank)),
        v AS (SELECT *, (SELECT arg_min(own, cap / weight) FROM l WHERE own * weight <= cap) AS level FROM l),
        t AS (SELECT source, source_size, ramp, least(cap::DOUBLE, coalesce(level * weight, cap::DOUBLE)) AS target FROM v),
        p AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, t.ramp,
                   CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffle, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        c AS (
            SELECT *, CAST(round(target) AS BIGINT) AS want, least(1.0::DOUBLE, greatest(0.0::DOUBLE, start::DOUBLE / nullif(target, 0))) AS part FROM p)
        SELECT doc_id, size, source_size, target,
               greatest(0, least(size, want - start)) + greatest(0, least(size, want - start - source_size)) AS taken,
               CASE WHEN greatest(0, least(size, want - start)) > 0 THEN abs(round(coalesce(
                   CASE WHEN ramp = 0 THEN part ELSE (sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * part) - (1 - ramp)) / (2 * ramp) END, 0.0), 9)) END AS first_time
        FROM c""",
}
