"""The registered queries of this subpackage and their DuckDB texts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitloom.llm import (
    byte_bpe,
    chat_windows,
    dart_minhash,
    decontamination,
    hyperplane_links,
    licence_scan,
    merkle_manifest,
    quality_cnn,
    quality_outliers,
    repair_shards,
    revisits,
    sharding,
    tokenizer_alignment,
)
from pitloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RANKS = "byte_bpe_multi_50k.tiktoken"
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def rank_file(path: str | None = None) -> bytes:
    with open(path or public_tokenizers.path(RANKS), "rb") as file:
        return file.read()


@query("op1_dart_minhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(byte_bpe.round_trip(table(spark, sf_dir, "documents"), rank_file(), public_tokenizers.PATTERN))


@query("op3_revisits", revisits.ORACLE_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.captures(table(spark, sf_dir, "pages")))
    return found.withColumn("merged_headers", revisits.header_lines(F.col("merged_headers")))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS gram
  FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS r(i) WHERE len(w) > 0),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS gram
  FROM d, (SELECT DISTINCT n FROM bw) AS sizes, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op4_decontamination", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")
    hits = decontamination.verdict(decontamination.find_hits(docs, table(spark, sf_dir, "benchmark")))
    items = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return hits.select(
        F.col("key").alias("doc_id"), "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated"
    )


OP5_SQL = r"""
WITH poly AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
                        lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM range(256) AS r(i))),
h AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (
  SELECT doc_id, size,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(x)::BIGINT, 2), lambda k: ('0x' || substr(x, k, 2))::BIGINT)),
                         lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295) AS text_crc32
  FROM h, poly),
p AS (
  SELECT *, (sum(size) OVER (ORDER BY doc_id, text_crc32 ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start,
         row_number() OVER (ORDER BY doc_id, text_crc32) AS nth, sum(size) OVER ()::BIGINT AS total FROM c),
s AS (SELECT *, least(7, ((2 * start + size) * 8) // (2 * total))::INTEGER AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, nth - min(nth) OVER (PARTITION BY shard) AS slot,
       NULL::INTEGER AS grown_shard FROM s
"""


@query("op5_sharding", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = sharding.assign_shards(table(spark, sf_dir, "documents"), 8)
    return places.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op6_chat_windows", chat_windows.ORACLE_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat_windows.with_control_conversation(spark, table(spark, sf_dir, "conversations"))
    return chat_windows.read_back(chat_windows.windows(rows))


@query("op7_repair_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(WORD_BPE), encoding="utf-8") as file:
        definition = file.read()
    return repair_shards.round_trip(table(spark, sf_dir, "documents"), definition)


@query("op8_licence_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = licence_scan.scan(docs, licence_scan.fit(docs))
    known = F.array_sort(F.array_distinct(F.transform("notices", lambda n: n["family"])))
    return found.select("doc_id", "n_paragraphs", F.size("notices").cast("long").alias("n_notices"), F.array_join(known, ",").alias("families"))


@query("op9_quality_cnn")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    aside = quality_cnn.held_out(F.col("doc_id"))
    net = quality_cnn.fit(docs, table(spark, sf_dir, "labels"), ~aside)
    scored = docs.select("doc_id", aside.alias("held_out"), quality_cnn.score(F.col("text"), net).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality_cnn.THRESHOLD).cast("int"))


@query("op10_quality_outliers")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_outliers.outlier_report(table(spark, sf_dir, "documents"))


@query("op11_merkle_manifest", merkle_manifest.ORACLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.verified_documents(table(spark, sf_dir, "documents"))


@query("op13_hyperplane_links", hyperplane_links.ORACLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperplane_links.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op12_tokenizer_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path(BYTE_BPE), encoding="utf-8") as file:
        definition = file.read()
    return tokenizer_alignment.align(table(spark, sf_dir, "documents"), definition, rank_file(public_tokenizers.path(PIECES)))[0]
