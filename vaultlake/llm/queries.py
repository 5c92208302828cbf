"""Registered queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultlake.llm.common import table
from vaultlake.llm.exact_dedup import exact_duplicates
from vaultlake.llm.language import identify
from vaultlake.llm.mixing import mix_sources
from vaultlake.llm.near_dup import near_duplicates
from vaultlake.llm.packing import best_fit
from vaultlake.llm.pii import find_personal_data
from vaultlake.llm.prefix_trie import prefix_trie
from vaultlake.llm.quality import classify
from vaultlake.llm.resampling import resample
from vaultlake.llm.secrets import find_secrets
from vaultlake.llm.sharding import shard_rows
from vaultlake.llm.topk import top_k
from vaultlake.llm.warc import archive_home, read_archives, write_archives


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(table(spark, sf_dir, "pages"), archive_home(spark))
    return read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))


def op9_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n_max=1, buckets=10_000, percent=10, least_words=20, seed=2024)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"), shards=16)


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_warc, op3_pii_boosting, op4_source_mix, op5_exact_topk, op6_quality_rules, op7_language_id, op8_best_fit_packing, op9_secret_crf, op10_minhash_near_dedup,
        op11_importance_resampling, op12_prefix_trie, op13_histogram_shards,
    )
}

#: DuckDB CTEs: the CRC-32 table of bytes, and unsigned crc32 of the texts x in a relation `crc_in`.
CRC32 = r"""
    crc_table AS (
        SELECT list(v ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                  lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
            FROM range(256) AS bytes(i)
        )
    ),
    crc_bytes AS (
        SELECT x, list_transform(range(1, 2 * octet_length(encode(x)), 2), lambda i: ('0x' || hex(encode(x))[i:i + 1])::BIGINT) AS b FROM crc_in
    ),
    crc AS (
        SELECT x, xor(list_reduce(list_concat([4294967295], b), lambda c, d: xor(c >> 8, t[(xor(c, d) & 255) + 1])), 4294967295) AS crc32
        FROM crc_bytes, crc_table
    )
"""

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
    "op2_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        r AS (SELECT h, max(page_id) AS first FROM p WHERE octet_length(encode(h)) >= 1000 GROUP BY h)
        SELECT page_id, octet_length(encode(p.h))::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
               CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM p LEFT JOIN r ON p.h = r.h
    """,
    "op5_exact_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::HUGEINT) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
        ),
        s AS (
            SELECT a.r, a.vec_id AS query_id, b.vec_id,
                   coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1] * z[2], 0))), 0)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.r <> b.r
        )
        SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
        QUALIFY rank <= 20
    """,
    "op11_importance_resampling": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
        own AS (SELECT r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM d),
        aim AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS x FROM benchmark),
        crc_in AS (SELECT x FROM own UNION SELECT x FROM aim),
        {CRC32},
        b AS MATERIALIZED (SELECT x, crc32 % 10000 AS bucket FROM crc),
        words AS (SELECT r, bucket, count(*) AS n FROM own JOIN b USING (x) GROUP BY r, bucket),
        s AS (SELECT bucket, sum(n)::DOUBLE AS s FROM words GROUP BY bucket),
        t AS (SELECT bucket, count(*)::DOUBLE AS t FROM aim JOIN b USING (x) GROUP BY bucket),
        gains AS (
            SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000))
                                         / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000))))::BIGINT AS gain
            FROM s LEFT JOIN t USING (bucket)
        ),
        weights AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM words JOIN gains USING (bucket) GROUP BY r),
        scored AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
            FROM d LEFT JOIN weights USING (r)
        ),
        able AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 10 * count(*) OVER () // 100 AS draw FROM scored WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= draw THEN place END::BIGINT AS rank FROM able
        UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < 20
    """.replace("{CRC32}", CRC32),
    "op12_prefix_trie": """
        WITH o AS (
            SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS own
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ),
        crc_in AS (SELECT conv_id::VARCHAR AS x FROM o),
        {CRC32},
        c AS (
            SELECT o.conv_id, crc32 % 6 AS h, o.own, base.own AS head
            FROM o JOIN crc ON x = o.conv_id::VARCHAR LEFT JOIN o AS base ON base.conv_id = o.conv_id - o.conv_id % 100
        ),
        r AS (SELECT conv_id, list_concat(head[1:h], own[h + 1:]) AS path FROM c),
        m AS (SELECT conv_id, len(path) AS n, unnest(range(0, len(path) + 1)) AS depth, path FROM r),
        nodes AS (
            SELECT depth, path[1:depth] AS node, min(conv_id) AS conv_id, count(*) AS n_convs,
                   coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends
            FROM m GROUP BY ALL
        ),
        child AS (SELECT depth - 1 AS depth, node[1:depth - 1] AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
        own AS (
            SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth > 0 THEN (n_convs - 1) * length(node[depth].text) ELSE 0 END AS saved
            FROM nodes LEFT JOIN child USING (depth, node)
        ),
        up AS (SELECT unnest(range(0, depth + 1)) AS d, node, saved, n_children = 0 AS leaf FROM own),
        below AS (SELECT d AS depth, node[1:d] AS node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE leaf) AS n_leaves FROM up GROUP BY ALL)
        SELECT own.conv_id, own.depth::BIGINT AS depth, parent.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, sha256(own.ends) AS ends_sha256
        FROM own JOIN below USING (depth, node) LEFT JOIN nodes AS parent ON parent.depth = own.depth - 1 AND parent.node = own.node[1:own.depth - 1]
    """.replace("{CRC32}", CRC32),
}
