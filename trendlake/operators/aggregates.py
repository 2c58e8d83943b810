"""Grouped statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendlake.functions.scoring import grade


def category_stats(entities: DataFrame, assignment: DataFrame, category: DataFrame) -> DataFrame:
    """Per category: entities, stars, the week's stars and the exact median quality; empty ones stay with zeros."""
    primary = assignment.where("is_primary").select("slug", F.col("entity_id").alias("id"))
    active = entities.where("status = 'active'").select("id", "stars", "stars_week", "quality_score")
    rows = primary.join(active, "id").groupBy("slug").agg(
        F.count("id").alias("n"), F.sum("stars").alias("stars"), F.sum("stars_week").alias("week"), F.percentile("quality_score", 0.5).alias("median_quality")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = category.join(rows, "slug", "left").select("slug", "group_slug", "sort_order", zero("n"), zero("stars"), zero("week"), "median_quality")
    return out.withColumn("median_grade", grade(F.col("median_quality")))


def group_stats(stats: DataFrame) -> DataFrame:
    """Category statistics rolled up to their groups."""
    return stats.groupBy("group_slug").agg(F.count("*").alias("categories"), F.sum("n").alias("n"), F.sum("stars").alias("stars"), F.sum("week").alias("week"))


def ordered_groups(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """:func:`group_stats` of every group in ``groups(group_slug, place)``, with its place from 1 and zeros where it has no category.

    Groups that only categories know come behind them, by the least order of their categories. Groups are few, so one task may number them.
    """
    own = group_stats(stats).join(stats.groupBy("group_slug").agg(F.min("sort_order").alias("__order")), "group_slug")
    both = own.join(groups.groupBy("group_slug").agg(F.min("place").alias("__place")), "group_slug", "full_outer")
    w = Window.orderBy(F.asc_nulls_last("__place"), "__order", "group_slug")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("group_slug", F.row_number().over(w).alias("place"), *[zero(c) for c in ("categories", "n", "stars", "week")])


def country_stats(entities: DataFrame, people: DataFrame) -> DataFrame:
    """Entities, stars and people of each country that either side knows; a missing side counts zero."""
    e = entities.where("status = 'active' and owner_country is not null").groupBy(F.col("owner_country").alias("country")).agg(F.count("*").alias("entities"), F.sum("stars").alias("stars"))
    p = people.where("country is not null").groupBy("country").agg(F.count("*").alias("people"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return e.join(p, "country", "full_outer").select("country", zero("entities"), zero("stars"), zero("people"))


def language_stats(entities: DataFrame) -> DataFrame:
    return entities.where("status = 'active' and language is not null").groupBy("language").agg(F.count("*").alias("n"), F.sum("stars").alias("stars"))


def global_stats(entities: DataFrame, people: DataFrame, category: DataFrame, since) -> DataFrame:
    """One row: totals, new entities, distinct languages and countries (nulls not counted), people, categories."""
    e = entities.where("status = 'active'").agg(
        F.count("*").alias("entities"),
        F.coalesce(F.sum("stars"), F.lit(0)).alias("stars"),
        F.coalesce(F.sum("stars_week"), F.lit(0)).alias("stars_week"),
        F.count_if(F.col("first_seen_on") >= since).alias("new_entities"),
        F.countDistinct("language").alias("languages"),
        F.countDistinct("owner_country").alias("countries"),
    )
    return e.join(F.broadcast(people.agg(F.count("*").alias("people")))).join(F.broadcast(category.agg(F.count("*").alias("categories"))))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table and of all."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("name").agg(F.sum("n").alias("n")).unionByName(out.agg(F.sum("n").alias("n")).select(F.lit("total").alias("name"), "n"))


def latest_ok_run(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'ok'").agg(F.max_by(F.struct("id", "job", "finished_at"), "finished_at").alias("run")).select("run.*")
