"""The numbered operators over their whole tables, as registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunk_dedup, mincut_html, nnls_packing, ppm, simhash, simple8b, source_mixing, suffix_pieces, token_cache, transport_stream, turn_repair, weak_quality, whitening
from .common import fresh_path


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_digest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache each time, so every distinct text is a miss."""
    return token_cache.count_tokens(_table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"), fresh_path(spark, "token-cache"))


def op2_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.stream_features(transport_stream.store_streams(_table(spark, sf_dir, "documents")))


def op3_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.coded_ids(_table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"))


def op4_mincut_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mincut_html.extracted(_table(spark, sf_dir, "pages"))


def op5_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op7_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_pieces.encoded_and_decoded(_table(spark, sf_dir, "documents"), _path("piece_bpe_32k.model"))


def held_out() -> Column:
    """Documents that are held out of learning by their id; one without an id is not, though
    ``learnable`` leaves it out too."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable() -> Column:
    """Documents that language models may learn from."""
    return F.col("doc_id").isNotNull() & ~held_out()


def op8_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = ppm.train(docs.where(learnable()))
    found = docs.select("doc_id", held_out().alias("held_out"), ppm.identify(spark, model, F.col("text")).alias("x"))
    return found.select("doc_id", "held_out", "x.lang_pred", "x.score", "x.bits_per_byte")


def op9_weak_label_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = weak_quality.train(docs)
    found = docs.select("doc_id", weak_quality.quality(spark, model, F.col("text")).alias("quality"))
    return found.select("doc_id", "quality", (F.col("quality") >= 0.3).alias("accepted"))


def op10_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nnls_packing.pack(_table(spark, sf_dir, "documents"), _path("word_bpe_49k.json"))


def op11_welford_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(_table(spark, sf_dir, "embeddings"))


def op12_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.taken(_table(spark, sf_dir, "documents"))


def op13_cost_layer_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.damaged_and_repaired(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_digest_cache,
        op2_transport_streams,
        op3_simple8b_ids,
        op4_mincut_html,
        op5_chunk_recipes,
        op6_simhash_trie,
        op7_suffix_array_pieces,
        op8_ppm_language,
        op9_weak_label_quality,
        op10_nnls_packing,
        op11_welford_whitening,
        op12_fair_queue_mix,
        op13_cost_layer_repair,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op5_chunk_recipes": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY text)""",
    "op12_fair_queue_mix": source_mixing.reference_sql(),
}
