"""The registered queries of these operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from trendlake.llm import decontaminate, language, negatives, oracles, packing, pii, pivots, repair, secrets, sharding, simhash, substrings, token_counts, toxicity, vocab
from trendlake.llm.common import unpack
from trendlake.storage import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and every page: doc_id or page_id, lang, posterior, accepted."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    none = F.lit(None).cast("long")
    rows = language.document_evidence(docs, F.struct(F.col("doc_id").cast("long").alias("doc_id"), none.alias("page_id")))
    rows = rows.unionByName(language.page_evidence(pages, F.struct(none.alias("doc_id"), F.col("page_id").cast("long").alias("page_id"))))
    found = language.identify(rows, language.train(docs))
    return found.select(*unpack(found, ["doc_id", "page_id"]), "lang", "posterior", "accepted")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links under its label, its component, and whether it stays."""
    return pivots.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, those of benchmark passages, and the items they are of."""
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id that its near copies have."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data."""
    return pii.replace(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_entities")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    return packing.pack(_table(spark, sf_dir, "documents"), vocab.default_path("word_bpe_49k.json"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens, behind a cache that an earlier job over the Spanish ones has filled.

    That job's counts are found in the cache; all other texts are misses.
    """
    docs, cache = _table(spark, sf_dir, "documents"), scratch_path(spark, "token-cache")
    path = vocab.default_path("byte_bpe_50k.json")
    token_counts.refresh(docs.where("lang = 'es'"), path, cache)
    return token_counts.count_tokens(docs, path, cache)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets: the base patterns and what the lexer adds."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op10_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard, slot, and shard among one more."""
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth vector and each of its five nearest of its label, ten hard negatives."""
    vectors = _table(spark, sf_dir, "embeddings")
    if isinstance(vectors.schema["label"].dataType, IntegralType):
        vectors = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 bytes and more that documents of smaller ids hold."""
    return substrings.repeated(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by known rules: its faults, the cheapest edits and the digest of the repaired text."""
    return repair.repair(repair.damage(_table(spark, sf_dir, "conversations")), gone="gone")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_embedding_dedup, op3_decontamination, op4_simhash_dedup, op5_toxicity, op6_pii_surrogates,
        op7_packing, op8_token_counts, op9_secret_scan, op10_jump_sharding, op11_hard_negatives, op12_suffix_dedup, op13_conversation_repair, pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op2_embedding_dedup": oracles.EMBEDDINGS, "op3_decontamination": oracles.DECONTAMINATION, "op11_hard_negatives": oracles.NEGATIVES, "op13_conversation_repair": oracles.REPAIR,
}
