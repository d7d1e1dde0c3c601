"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weftbook.llm import (
    byte_pairs,
    exact_dedup,
    html_wrappers,
    licences,
    near_dedup,
    packing,
    pair_bitmaps,
    periodic_runs,
    quality,
    sentence_pieces,
    sharding,
    topk,
    warc,
)
from weftbook.llm.common import table


def op1_suffix_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentence_pieces.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"))


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.piece_digests(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")))


def op3_host_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.extract(table(spark, sf_dir, "pages"))


def op4_trie_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(warc.archive_pages(table(spark, sf_dir, "pages")))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents")).drop("matches")


def op8_segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k_every(table(spark, sf_dir, "embeddings"))


def op9_odd_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_differencing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_pairs.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_pair_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return pair_bitmaps.alignment_digests(docs, *paths)


def op13_suffix_tree_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_repeats(table(spark, sf_dir, "documents"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(docs))


QUERIES = {
    "op1_suffix_pieces": op1_suffix_pieces,
    "op2_harmonic_packing": op2_harmonic_packing,
    "op3_host_wrappers": op3_host_wrappers,
    "op4_trie_dedup": op4_trie_dedup,
    "op5_positive_unlabelled": op5_positive_unlabelled,
    "op6_warc_salvage": op6_warc_salvage,
    "op7_licence_scan": op7_licence_scan,
    "op8_segment_search": op8_segment_search,
    "op9_odd_sketches": op9_odd_sketches,
    "op10_differencing_shards": op10_differencing_shards,
    "op11_merge_replay": op11_merge_replay,
    "op12_pair_bitmaps": op12_pair_bitmaps,
    "op13_suffix_tree_runs": op13_suffix_tree_runs,
}

ORACLE: dict[str, str] = {
    "op4_trie_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare
  FROM documents
)
SELECT doc_id,
  first_value(doc_id) OVER (PARTITION BY bare ORDER BY chars DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY bare) AS group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY bare ORDER BY chars DESC, doc_id) AS kept,
  sha256(bare) AS text_sha256
FROM d""",
    "op6_warc_salvage": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
s AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
m AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS answer FROM s)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN answer = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN answer <> page_id THEN answer END AS refers_to
FROM m""",
    "op7_licence_scan": licences.oracle(),
    "op8_segment_search": """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
}
