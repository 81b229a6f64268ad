"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, embed_dedup, html_extract, jaccard, packing, quality, sharding, toxicity, warc
from .common import Scratch, read


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read(spark, sf_dir, "pages"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read(spark, sf_dir, "pages"), Scratch(spark, "warc"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_held_out(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), Scratch(spark, "decontam"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.extendible_shards(read(spark, sf_dir, "documents"), Scratch(spark, "sharding"), limit=SHARD_BYTES)
    return placed.withColumnRenamed("key", "doc_id")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read(spark, sf_dir, "documents"), Scratch(spark, "jaccard"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        text.alias("text"),
    )
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), Scratch(spark, "quality"))
    return judged.drop("h")


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(read(spark, sf_dir, "embeddings"), Scratch(spark, "embeddings"))


#: Byte limit of a shard that a data loader streams.
SHARD_BYTES = 1 << 20

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_warc": op2_warc,
    "op3_toxicity": op3_toxicity,
    "op4_decontamination": op4_decontamination,
    "op5_packing": op5_packing,
    "op6_sharding": op6_sharding,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_embedding_near_dedup": op10_embedding_near_dedup,
}

ORACLE_SQL = {
    "op2_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        h AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS x FROM p),
        d AS (
          SELECT page_id, payload_bytes, (
            SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(x, 1 + 5 * (k // 4), 5))::BIGINT >> (5 * (3 - k % 4))) & 31)::BIGINT, 1), '' ORDER BY k)
            FROM range(32) AS r(k)) AS payload_digest
          FROM h),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
          CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
          CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
        FROM m""",
    "op4_decontamination": r"""
        WITH w AS (
          SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
        s AS (
          SELECT side, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
          FROM w),
        g AS (
          SELECT side, id, unnest(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS t
          FROM s WHERE len(ws) >= 5),
        n AS (SELECT id, count(*) AS n FROM g WHERE side = 'i' GROUP BY id)
        SELECT d.id AS doc_id, i.id AS item_id, CAST(count(*) AS DOUBLE) / max(n.n) AS containment
        FROM g d JOIN g i ON d.t = i.t AND d.side = 'd' AND i.side = 'i' JOIN n ON n.id = i.id
        GROUP BY d.id, i.id HAVING 4 * count(*) >= 3 * max(n.n)""",
    "op6_sharding": f"""
        WITH r AS (
          SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS row_bytes,
            ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(text, '')), 1, 15))::BIGINT AS h
          FROM documents),
        l AS (SELECT doc_id, row_bytes, h, CAST(d AS INTEGER) AS depth FROM r, range(0, 31) AS g(d)),
        s AS (SELECT depth, h >> (60 - depth) AS prefix, sum(row_bytes) AS shard_bytes FROM l GROUP BY ALL HAVING sum(row_bytes) <= {SHARD_BYTES}),
        f AS (SELECT l.*, s.shard_bytes, row_number() OVER (PARTITION BY doc_id, h ORDER BY l.depth) AS n
              FROM l JOIN s ON l.depth = s.depth AND l.h >> (60 - l.depth) = s.prefix)
        SELECT doc_id, CAST(row_bytes AS BIGINT) AS row_bytes,
          CASE WHEN depth = 0 THEN '' ELSE substr(lpad(bin(h), 60, '0'), 1, depth) END AS shard,
          depth, CAST(0 AS BIGINT) AS page, CAST(shard_bytes AS BIGINT) AS shard_bytes
        FROM f WHERE n = 1""",
    "op7_jaccard_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
          FROM documents),
        s AS (
          SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
            ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS g
          FROM w),
        u AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
        c AS (SELECT *, count(*) OVER (PARTITION BY t) AS df FROM u),
        o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY df, t) AS pos FROM c),
        p AS (SELECT doc_id, n, t FROM o WHERE pos <= n - (75 * n + 99) // 100 + 1 AND df > 1),
        k AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS na, y.n AS nb FROM p x JOIN p y ON x.t = y.t AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n)),
        e AS (SELECT k.a, k.b FROM k JOIN u x ON x.doc_id = k.a JOIN u y ON y.doc_id = k.b AND x.t = y.t
              GROUP BY k.a, k.b, k.na, k.nb HAVING 100 * count(*) >= 75 * (k.na + k.nb - count(*))),
        b AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT b.b, r.c FROM r JOIN b ON r.doc_id = b.a WHERE r.c < b.b)
        SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, m.c AS component_id
        FROM s JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON s.doc_id = m.doc_id""",
    "op8_chat_formatting": r"""
        WITH c AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        n AS (
          SELECT *, regexp_replace(regexp_replace(regexp_replace(text, '(<)(\\*)([|｜][^|｜<>\[]*[|｜]>|/?[A-Za-z0-9_][A-Za-z0-9_.:-]*>)', '\1\\\2\3', 'g'),
              '(\[)(\\*)(/?[A-Z][A-Z0-9_]*\])', '\1\\\2\3', 'g'), '(<)(\\*)(<\\*[^<>\[]*>>)', '\1\\\2\3', 'g') AS e,
            regexp_replace(regexp_replace(regexp_replace(role, '(<)(\\*)([|｜][^|｜<>\[]*[|｜]>|/?[A-Za-z0-9_][A-Za-z0-9_.:-]*>)', '\1\\\2\3', 'g'),
              '(\[)(\\*)(/?[A-Z][A-Z0-9_]*\])', '\1\\\2\3', 'g'), '(<)(\\*)(<\\*[^<>\[]*>>)', '\1\\\2\3', 'g') AS r,
            lag(role) OVER w AS before, lead(role) OVER w AS later
          FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
        f AS (
          SELECT *, (CASE WHEN before IS NULL OR before <> role THEN '<|im_start|>' || r || '<|body|>' ELSE '<|part|>' END) || e
            || (CASE WHEN later IS NULL OR later <> role THEN '<|im_end|>' || chr(10) ELSE '' END) AS s
          FROM n)
        SELECT conv_id, count(*) AS n_turns,
          sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
          CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
          sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
          CAST(sum(length(s)) AS BIGINT) AS formatted_chars
        FROM f GROUP BY conv_id""",
}
