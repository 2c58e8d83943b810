"""Text exports: addresses and structured data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ADDRESSES = 45_000


def encoded(part: Column) -> Column:
    """Percent-encoded path part (a blank is %20)."""
    return F.replace(F.url_encode(part), F.lit("+"), F.lit("%20"))


def addresses(entities: DataFrame, category: DataFrame, base: str, now: Column, fixed_paths: list[str]) -> DataFrame:
    """url, lastmod of the most-starred entities, all categories and the fixed paths."""
    top = entities.where("status = 'active'").orderBy(F.desc("stars"), F.desc("id")).limit(MOST_ADDRESSES)
    url = F.concat(F.lit(f"{base}/repos/"), encoded(F.col("owner_login")), F.lit("/"), encoded(F.col("name")))
    rows = top.select(url.alias("url"), F.coalesce("synced_on", "pushed_on", now).alias("lastmod"))
    cats = category.select(F.concat(F.lit(f"{base}/categories/"), encoded(F.col("slug"))).alias("url"), now.alias("lastmod"))
    spark = entities.sparkSession
    fixed = spark.createDataFrame([(f"{base}{p}",) for p in fixed_paths], "url string").select("url", now.alias("lastmod"))
    return rows.unionByName(cats).unionByName(fixed)


def structured(entities: DataFrame) -> DataFrame:
    """One JSON text an entity; nulls are left out."""
    body = F.struct(F.lit("SoftwareSourceCode").alias("type"), "name", F.col("full_name").alias("identifier"), "description", F.col("language").alias("programmingLanguage"), F.col("license_spdx_id").alias("license"))
    return entities.select("id", F.to_json(body).alias("body"))
