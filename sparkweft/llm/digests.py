"""What the opN queries return, derived from the operators' own outputs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exact_dedup, language_id, license_scan, line_dedup, lm_scoring, packing, passage_dedup, sharding, simhash
from .common import id_crc, importable, table, text_or_empty


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.lm_scores(table(spark, sf_dir, "documents"), id_crc("doc_id") % 10 == 0)
    return scored.withColumnRenamed("id", "doc_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "removed_chunks", "removed_lines", F.length("clean_text").cast("long").alias("clean_chars"), F.sha2("clean_text", 256).alias("clean_sha256"))


OP2_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h,
         strlen(line) >= 200 AS is_long FROM split
), ended AS (
  SELECT *, is_long OR ((coalesce(lag(h, 2) OVER w, 0) * 961 + coalesce(lag(h, 1) OVER w, 0) * 31) % 1000003 + h) % 1000003 % 3 = 0 AS ends
  FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), started AS (
  SELECT *, is_long OR coalesce(lag(ends) OVER (PARTITION BY doc_id ORDER BY i), true) AS starts FROM ended
), numbered AS (
  SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM started
), chunks AS (
  SELECT doc_id, pos, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n_lines, bool_or(is_long) AS is_long
  FROM numbered GROUP BY doc_id, pos
), judged AS (
  SELECT *, (n_lines > 1 OR is_long) AND (row_number() OVER (PARTITION BY chunk, n_lines > 1 OR is_long ORDER BY doc_id, pos)) > 1 AS gone
  FROM chunks
), cleaned AS (
  SELECT doc_id, sum(n_lines)::BIGINT AS n_lines, count(*) FILTER (gone) AS removed_chunks,
         coalesce(sum(n_lines) FILTER (gone), 0)::BIGINT AS removed_lines,
         coalesce(string_agg(chunk, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS clean
  FROM judged GROUP BY doc_id
)
SELECT doc_id, n_lines, removed_chunks, removed_lines, length(clean) AS clean_chars, sha256(clean) AS clean_sha256 FROM cleaned
"""


def op2_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = passage_dedup.passage_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "removed_passages", "removed_lines", F.length("clean_text").cast("long").alias("clean_chars"), F.sha2("clean_text", 256).alias("clean_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_report(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""


def _round_trip(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(path)
        for batch in batches:
            rows = []
            for ids in encoder.encode_batch(batch.column(1).to_pylist()):
                rows.append((len(ids), hashlib.sha256(encoder.shown(ids).encode()).hexdigest(), hashlib.sha256(encoder.decode(ids).encode()).hexdigest()))
            n, of_ids, of_text = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def op10_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    importable(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty("text").alias("text"))
    return docs.mapInArrow(_round_trip(vocabulary or public_tokenizers.path("byte_bpe_50k.json")), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")



def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = license_scan.license_report(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return report.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", id_crc("doc_id") % 5 == 0)
    model = language_id.learn(docs.where(~F.col("held_out")))
    found = language_id.identify(docs, model, spans=False)
    return found.select(F.col("id").alias("doc_id"), (id_crc("id") % 5 == 0).alias("held_out"), "lang_pred", "score")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary or public_tokenizers.path("word_bpe_49k.json"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring, "op2_line_dedup": op2_line_dedup, "op3_license_scan": op3_license_scan, "op4_simhash": op4_simhash, "op5_language_id": op5_language_id,
    "op6_ann": op6_ann, "op7_sharding": op7_sharding, "op8_exact_dedup": op8_exact_dedup, "op9_packing": op9_packing, "op10_bpe": op10_bpe, "op2_passage_dedup": op2_passage_dedup,
}
ORACLES = {"op2_line_dedup": OP2_SQL, "op8_exact_dedup": OP8_SQL}
