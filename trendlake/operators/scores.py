"""The scoring pass: gains, growth, trend, quality and flags of every entity, and what of them changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from trendlake.functions import scoring
from trendlake.operators import merge, temporal

SCORES = ["trend_score", "trend_velocity", "quality_score", "quality_grade", "quality_flags"]
GAINS = ["stars_day", "stars_week", "stars_month"]


def scored(entities: DataFrame, metrics: DataFrame, now: Column) -> DataFrame:
    """Entities with gains, growth, the structs ``t`` (trend) and ``q`` (quality), and the columns in ``SCORES``."""
    df, c = temporal.week_and_gains(entities, metrics, now), F.col
    t = scoring.trend(c("stars"), c("stars_day"), c("stars_week"), c("contributors_week"), c("released_on"), c("pushed_on"), c("created_on"), c("is_archived"), now)
    some = lambda name: F.coalesce(c(name), F.lit("")) != ""
    q = scoring.quality(
        {
            "stars": c("stars"), "open_issues": c("open_issues"), "contributors": c("contributors_count"), "share": c("top_contributor_share"),
            "pushed": c("pushed_on"), "released": c("released_on"), "releases_last_year": c("releases_last_year"), "licence": c("license_spdx_id"),
            "readme_length": c("readme_length"), "has_homepage": some("homepage"), "has_description": some("description"),
            "topics": c("topics_count"), "archived": c("is_archived"), "fork": c("is_fork"),
        },
        now,
    )
    made = {"trend_score": c("t.score"), "trend_velocity": c("t.velocity"), "quality_score": c("q.score"), "quality_grade": c("q.grade"), "quality_flags": c("q.flags")}
    return df.drop(*made).withColumns({"t": t, "q": q}).select("*", *[v.alias(k) for k, v in made.items()])


class Figures:
    """What a scoring pass did, counted while its rows are written."""

    def __init__(self) -> None:
        self._scored, self._changed = Observation(), Observation()

    def watch(self, rows: DataFrame) -> DataFrame:
        """All scored rows."""
        grade = F.col("quality_grade")
        return rows.observe(
            self._scored, F.count(F.lit(1)).alias("scored"), F.count_if(grade == "A").alias("grade_a"), F.count_if(grade == "F").alias("grade_f"),
            F.count_if(F.size("quality_flags") > 0).alias("flagged"),
        )

    def watch_changed(self, rows: DataFrame) -> DataFrame:
        return rows.observe(self._changed, F.count(F.lit(1)).alias("changed"))

    def get(self) -> dict[str, int]:
        """Figures of the write that both frames took part in."""
        return self._scored.get | self._changed.get


def changed(entities: DataFrame, metrics: DataFrame, now: Column, figures: Figures | None = None) -> DataFrame:
    """Active entities whose scores are unlike the stored ones, with the new ones."""
    figures = figures or Figures()
    rows = figures.watch(scored(entities.where("status = 'active'"), metrics, now)).select("id", *SCORES)
    before = entities.select("id", F.struct(*entities.columns).alias("__old"))
    differs = F.lit(False)
    for c in SCORES:
        differs = differs | ~F.col(c).eqNullSafe(F.col("__old")[c])
    new = rows.join(before, "id").where(differs)
    return figures.watch_changed(new).select(*[F.col(c) if c in SCORES else F.col("__old")[c].alias(c) for c in entities.columns])


def gained(entities: DataFrame, metrics: DataFrame, now: Column) -> DataFrame:
    """Entities whose gains are unlike the stored ones, with the new ones."""
    new = temporal.deltas(entities.select("id", "stars"), metrics, now).select("id", *GAINS)
    fresh = merge.changed_only(entities, new, "id", GAINS)
    return merge.upsert(entities, fresh, ["id"]).where("touched").select(*entities.columns)
