"""The operators as named queries over the given tables, and SQL for those it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode
from .collocations import collocations
from .common import table
from .conversation_repair import damage, repair_report
from .decontamination import contamination
from .exact_dedup import exact_groups
from .language_id import fold, identify, sample_dictionaries
from .lm_scoring import score_texts
from .mixing import mix_report
from .oracles import MIX_SQL, PHRASE_SQL, REPAIR_SQL
from .quality import score_quality, train
from .sharding import SLOT_PARTS, shard_documents
from .simhash import near_groups
from .suffix_dedup import remove_repeats
from .token_counts import token_counts

SHARDS = 24


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"),
                        public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(7) == 2
    scores = score_texts(docs, ~held_out)
    return scores.withColumn("held_out", held_out)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"),
                  public_tokenizers.PATTERN, ids=False, digests=True).drop("text")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), words=4, distance=4)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold(5) == 0
    learned = sample_dictionaries(docs.filter(~held_out))
    return identify(docs, learned, ["doc_id", held_out.alias("held_out")])


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source is the host, the language within it the path."""
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")),
                         F.col("source"), F.col("lang"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(damage(table(spark, sf_dir, "conversations")))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_simhash": op6_simhash,
    "op7_language_id": op7_language_id,
    "op8_sharding": op8_sharding,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality": op10_quality,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_source_mix": op12_source_mix,
    "op13_collocations": op13_collocations,
}

EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

# CRC-32 by its definition: one table entry per byte value, then one step per byte.
CRC_SQL = """
crc_table AS (
  SELECT list(v ORDER BY i) AS entries FROM (
    SELECT i, list_reduce(range(8), lambda c, k:
      CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
    FROM range(256) AS t(i))),
bytes AS (
  SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, ''))) AS n,
         hex(encode(coalesce(text, ''))) AS digits FROM documents),
sums AS (
  SELECT doc_id, n + 8 AS size, xor(list_reduce(
    list_transform(range(n), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)
    AS text_crc32
  FROM bytes, crc_table)
"""

SHARD_SQL = f"""
WITH {CRC_SQL},
bids AS (
  SELECT doc_id, s, ('0x' || left(md5(doc_id || ':' || s), 13))::BIGINT AS bid
  FROM (SELECT DISTINCT doc_id FROM documents), range({SHARDS + 1}) AS t(s)),
won AS (
  SELECT doc_id, arg_max(s, bid) FILTER (s < {SHARDS}) AS shard, arg_max(s, bid) AS grown
  FROM bids GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (
         PARTITION BY shard
         ORDER BY ('0x' || left(md5(doc_id || ':slot'), 3))::BIGINT % {SLOT_PARTS}, doc_id) - 1
         AS slot,
       grown::INTEGER AS grown_shard
FROM sums JOIN won USING (doc_id)
"""

# A document word is hit if any of the windows that may begin up to a window's length before
# it is a window of an item.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WINDOW_SQL = f"""
WITH item_words AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all({LOWER}, '{WORDS}') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1:i + 10], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i
        FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT doc_id, regexp_extract_all({LOWER}, '{WORDS}') AS w FROM documents),
starts AS (
  SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS win
  FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM doc_words),
       (SELECT DISTINCT n FROM windows)
  WHERE i + n <= len(w)),
found AS (SELECT doc_id, i, n, item_id FROM starts JOIN windows USING (n, win)),
hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found))
  GROUP BY doc_id),
owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN owners USING (doc_id)
"""

ORACLES = {
    "op2_exact_dedup": EXACT_SQL,
    "op3_decontamination": WINDOW_SQL,
    "op8_sharding": SHARD_SQL,
    "op11_conversation_repair": REPAIR_SQL,
    "op12_source_mix": MIX_SQL,
    "op13_collocations": PHRASE_SQL,
}
