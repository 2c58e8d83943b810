"""Token counts behind a cache of digests.

A stored count is found by the digest of the normalised content and the digest of the
tokenizer's file. Only distinct texts without one are encoded, and their counts are appended to
the cache, a Parquet table in a folder that all executors share, with a partition for each tokenizer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from trendlake.llm import vocab
from trendlake.llm.common import column, frugal, lookup
from trendlake.storage import materialize, scratch_path

LIMIT = 512
#: Missing digests (32 bytes each) that are broadcast to pick their texts; more are joined by shuffle.
FEW = 100_000
SCHEMA = "digest binary, n_tokens long, tokenizer string"


def normalised(text: Column) -> Column:
    """What is digested: a null text is an empty one. Anything more could change the count."""
    return F.coalesce(text.cast("string"), F.lit(""))


def digest(content: Column) -> Column:
    return F.unhex(F.sha2(content, 256))


def _count_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = vocab.counter(path)
        for batch in batches:
            counts = [counter.count(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def stored(spark: SparkSession, cache_path: str, tokenizer: str) -> DataFrame:
    """The cached counts of one tokenizer version; none where the cache does not exist yet."""
    try:
        cache = spark.read.schema(SCHEMA).parquet(cache_path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cache = spark.createDataFrame([], SCHEMA)
    return cache.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def refresh(docs: DataFrame, tokenizer_path: str, cache_path: str, text: str = "text") -> DataFrame:
    """digest, n (rows that have it) and n_tokens of every distinct text; new counts go to the cache.

    Digests alone are grouped and joined to the cache. Copies of a text are dropped where they are
    read, before any text moves; where at most ``FEW`` digests are missing, so are all others.
    """
    spark = docs.sparkSession
    tokenizer = vocab.version(tokenizer_path)
    content = normalised(column(text))
    digested = docs.select(digest(content).alias("digest"), content.alias("text"))
    held = digested.groupBy("digest").agg(F.count("*").alias("n"))
    held = materialize(held.join(stored(spark, cache_path, tokenizer), "digest", "left"), "held")
    known, missing = held.where("n_tokens is not null"), held.where("n_tokens is null").select("digest", "n")
    n_missing = missing.count()
    if not n_missing:
        return known
    if n_missing <= FEW:
        digested = digested.join(F.broadcast(missing.select("digest")), "digest", "left_semi")
    distinct = digested.groupBy("digest").agg(F.first("text").alias("text"))
    if n_missing > FEW and not known.isEmpty():
        distinct = distinct.join(missing.select("digest"), "digest", "left_semi")
    counted = materialize(distinct.mapInArrow(frugal(_count_batches(tokenizer_path), holds=True), "digest binary, n_tokens long"), "counted")
    rows = counted.select("digest", "n_tokens", F.lit(tokenizer).alias("tokenizer"))
    rows.write.partitionBy("tokenizer").mode("append").parquet(cache_path)
    return known.unionByName(missing.join(counted, "digest"))


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str | None = None,
    key: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every row of ``docs``.

    A null text counts as empty (no tokens); texts of any length are encoded whole. Equal texts are
    encoded once, and a digest that very many rows have meets its count without being gathered in
    one task. Repeated rows get equal results and null ids stay null; other columns are not read; an
    empty table gives no rows. Without ``cache_path`` a new cache is begun.
    """
    counts = refresh(docs, tokenizer_path, cache_path or scratch_path(docs.sparkSession, "token-counts"), text)
    content = normalised(column(text))
    rows = docs.select(
        column(key).alias("id"), digest(content).alias("digest"), F.octet_length(content).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("place")
    )
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = lookup(rows, counts, ["digest"], F.xxhash64("place"), total)
    return found.select(F.col("id").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
