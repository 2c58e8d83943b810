"""Queries on snapshots, scores and series."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendlake.functions import scoring
from trendlake.operators import scores, temporal
from trendlake.plans.registry import query
from trendlake.plans.views import spark_view, table, with_views
from trendlake.storage import materialize, release, scratch_path
from trendlake.streaming import observations
from trendlake.versions import Tables, state_of

_ASOF = (
    "earlier AS (SELECT id, arg_max(stars, recorded_on) FILTER (recorded_on <= now - 1) AS d1, arg_max(stars, recorded_on) FILTER (recorded_on <= now - 7) AS d7, "
    "arg_max(stars, recorded_on) FILTER (recorded_on <= now - 30) AS d30 FROM metrics, today GROUP BY id), "
    "gains AS (SELECT e.*, COALESCE(stars - d1, 0) AS stars_day, COALESCE(stars - d7, 0) AS stars_week, COALESCE(stars - d30, 0) AS stars_month FROM entity e LEFT JOIN earlier USING (id)), "
)
_GROWTH = (
    "before AS (SELECT id, contributors_count AS was FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded_on DESC) AS rn FROM metrics, today WHERE recorded_on <= now - 7) t WHERE rn = 1), "
    "grown AS (SELECT e.id, COALESCE(GREATEST(e.contributors_count - was, 0), 0) AS contributors_week FROM entity e LEFT JOIN before USING (id)), "
)
_TREND = (
    "parts AS (SELECT g.*, contributors_week, now, GREATEST(stars_day, 0) AS dd, GREATEST(stars_week, 0) AS ww, "
    "CASE WHEN released_on IS NULL THEN 0 WHEN now - released_on <= 7 THEN 60 WHEN now - released_on <= 30 THEN 35 WHEN now - released_on <= 90 THEN 15 WHEN now - released_on <= 180 THEN 5 ELSE 0 END AS rel, "
    "CASE WHEN pushed_on IS NULL THEN 0 WHEN now - pushed_on > 365 THEN 250 WHEN now - pushed_on > 180 THEN 120 WHEN now - pushed_on > 90 THEN 50 WHEN now - pushed_on > 30 THEN 15 ELSE 0 END AS idle, "
    "CASE WHEN now - created_on <= 90 AND stars_week > 0 THEN stars_week * (1 - (now - created_on) / 90.0::DOUBLE) * 1.5::DOUBLE ELSE 0 END AS nov "
    "FROM gains g JOIN grown USING (id), today), "
    "trend AS (SELECT *, CASE WHEN is_archived THEN 0 ELSE FLOOR(GREATEST(4.0::DOUBLE * dd + ww + 10 * contributors_week + rel + nov - idle, 0) * 100 + 0.5) / 100 END AS trend_score, "
    "CASE WHEN is_archived THEN 0 ELSE FLOOR(ww / GREATEST(stars - ww, 50)::DOUBLE * 100000 + 0.5) / 100000 END AS trend_velocity FROM parts), "
)
_LICENCE = (
    "CASE WHEN COALESCE(TRIM(license_spdx_id), '') = '' THEN 'none' WHEN license_spdx_id = 'MIT' THEN 'permissive' WHEN license_spdx_id = 'MPL-2.0' THEN 'weak-copyleft' "
    "WHEN license_spdx_id = 'AGPL-3.0' THEN 'strong-copyleft' WHEN license_spdx_id = 'X-NC-1.0' THEN 'non-commercial' ELSE 'other' END"
)
_QUALITY = (
    f"lic AS (SELECT *, {_LICENCE} AS license_class, COALESCE(contributors_count, 0) AS cc, COALESCE(readme_length, 0) AS rl FROM trend), "
    "dims AS (SELECT *, CASE WHEN pushed_on IS NULL THEN 0 WHEN now - pushed_on <= 7 THEN 1 WHEN now - pushed_on <= 30 THEN 0.9 WHEN now - pushed_on <= 90 THEN 0.7 WHEN now - pushed_on <= 180 THEN 0.45 WHEN now - pushed_on <= 365 THEN 0.2 ELSE 0.05 END::DOUBLE AS maintenance, "
    "CASE WHEN released_on IS NULL THEN 0.25 ELSE 0.65::DOUBLE * (CASE WHEN now - released_on <= 30 THEN 1 WHEN now - released_on <= 90 THEN 0.85 WHEN now - released_on <= 180 THEN 0.6 WHEN now - released_on <= 365 THEN 0.35 ELSE 0.15 END)::DOUBLE "
    "+ 0.35::DOUBLE * COALESCE(releases_last_year, 1)::DOUBLE / (COALESCE(releases_last_year, 1) + 4) END AS releases, "
    "0.6::DOUBLE * cc / (cc + 12)::DOUBLE + 0.4::DOUBLE * (CASE WHEN top_contributor_share IS NOT NULL AND cc > 0 THEN LEAST(GREATEST(1 - (top_contributor_share - 0.4::DOUBLE) / 0.55::DOUBLE, 0), 1) WHEN cc = 1 THEN 0.15 ELSE 0.5 END)::DOUBLE AS community, "
    "CASE WHEN stars > 0 THEN CASE WHEN open_issues / stars::DOUBLE <= 0.01 THEN 1 WHEN open_issues / stars::DOUBLE <= 0.03 THEN 0.85 WHEN open_issues / stars::DOUBLE <= 0.06 THEN 0.6 WHEN open_issues / stars::DOUBLE <= 0.12 THEN 0.35 ELSE 0.15 END ELSE 0.5 END::DOUBLE AS responsiveness, "
    "LEAST(CASE WHEN rl <= 0 THEN 0 ELSE rl / (rl + 3000)::DOUBLE END + CASE WHEN COALESCE(homepage, '') <> '' THEN 0.15 ELSE 0 END::DOUBLE + CASE WHEN description IS NOT NULL THEN 0.05 ELSE 0 END::DOUBLE + CASE WHEN topics_count >= 3 THEN 0.05 ELSE 0 END::DOUBLE, 1) AS documentation, "
    "CASE license_class WHEN 'permissive' THEN 1 WHEN 'weak-copyleft' THEN 0.8 WHEN 'strong-copyleft' THEN 0.55 WHEN 'other' THEN 0.35 WHEN 'non-commercial' THEN 0.15 ELSE 0 END::DOUBLE AS licensing FROM lic), "
    "qual AS (SELECT *, CAST(FLOOR(LEAST(GREATEST((maintenance * 26 + releases * 14 + community * 20 + responsiveness * 14 + documentation * 14 + licensing * 12) * CASE WHEN is_archived THEN 0.35 ELSE 1 END::DOUBLE * CASE WHEN is_fork THEN 0.8 ELSE 1 END::DOUBLE, 0), 100) + 0.5) AS INT) AS quality_score FROM dims), "
    "scored AS (SELECT *, CASE WHEN quality_score >= 80 THEN 'A' WHEN quality_score >= 65 THEN 'B' WHEN quality_score >= 50 THEN 'C' WHEN quality_score >= 35 THEN 'D' ELSE 'F' END AS quality_grade FROM qual) "
)
GAINS_SQL = with_views("metrics", "today", "entity").rstrip() + ", " + _ASOF
SCORED_SQL = GAINS_SQL + _GROWTH + _TREND + _QUALITY


def now_of(spark: SparkSession, sf_dir: str):
    """The frozen clock: the day after the last one, as a literal."""
    return F.lit(spark_view(spark, sf_dir, "today").first()["now"])


def gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.deltas(spark_view(spark, sf_dir, "entity"), spark_view(spark, sf_dir, "metrics"), now_of(spark, sf_dir))


_STORED: dict[str, tuple[str, DataFrame]] = {}


def stored_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored entities as the scoring pass leaves them, made anew when a file of the tables behind them is another."""
    state = spark.sparkContext.applicationId + state_of(spark, [f"{sf_dir}/{t}.parquet" for t in ("part", "lineitem", "nation")])
    if _STORED.get(sf_dir, ("",))[0] != state:
        _STORED[sf_dir] = state, materialize(scored(spark, sf_dir), "scored")
    return _STORED[sf_dir][1]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with deltas, growth, trend and quality columns."""
    return scores.scored(spark_view(spark, sf_dir, "entity"), spark_view(spark, sf_dir, "metrics"), now_of(spark, sf_dir))


@query(GAINS_SQL + "v AS (SELECT *, FLOOR(stars_week / GREATEST(50, stars - stars_week)::DOUBLE * 100000 + 0.5) / 100000 AS velocity FROM gains) SELECT id, name, stars, stars_week, velocity FROM v ORDER BY stars_week DESC, id DESC LIMIT 24")
def top_risers(spark, sf_dir):
    velocity = scoring.fixed(F.col("stars_week") / F.greatest(F.lit(50), F.col("stars") - F.col("stars_week")), 5)
    df = gains(spark, sf_dir).withColumn("velocity", velocity)
    return df.orderBy(F.desc("stars_week"), F.desc("id")).limit(24).select("id", "name", "stars", "stars_week", "velocity")


@query(GAINS_SQL + "z AS (SELECT 1) SELECT id, stars, stars_day, stars_week, stars_month FROM gains")
def star_deltas(spark, sf_dir):
    return gains(spark, sf_dir).select("id", "stars", "stars_day", "stars_week", "stars_month")


@query(GAINS_SQL + "z AS (SELECT 1) SELECT id, stars, stars_day, stars_week, stars_month FROM gains")
def stored_star_deltas(spark, sf_dir):
    """The same gains from metrics stored by month, with anchors carried from month to month; history is not read again."""
    today = spark_view(spark, sf_dir, "today").first()["now"]
    metrics = spark_view(spark, sf_dir, "metrics").withColumn("month", F.date_format("recorded_on", "yyyy-MM"))
    earlier, *months = temporal.months_back(today, 62)
    tables = Tables(spark, scratch_path(spark, "metrics"))
    tables.create({"metrics": (metrics, ["id", "recorded_on"], 1, "month"), "anchor": (temporal.anchors(earlier, metrics), ["id", "month"], 1, "month")})
    for month in months:
        before = tables.read("anchor", only={"month": [earlier]})
        tables.change(month, "anchors", {"anchor": temporal.anchors(month, tables.read("metrics", only={"month": [earlier]}), before)})
        earlier = month
    return temporal.stored_deltas(tables, spark_view(spark, sf_dir, "entity").select("id", "stars"), today)


@query(with_views("metrics", "today") + "SELECT id, CAST(recorded_on AS VARCHAR) AS last_day, stars, contributors_count FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY recorded_on DESC) AS rn FROM metrics, today WHERE recorded_on < now - 30) t WHERE rn = 1")
def as_of_strict(spark, sf_dir):
    cutoff = F.date_sub(now_of(spark, sf_dir), 30)
    df = temporal.as_of(spark_view(spark, sf_dir, "metrics"), {"r": cutoff}, ["stars", "contributors_count"], strict=True).where("r is not null")
    return df.select("id", F.col("r.recorded_on").cast("string").alias("last_day"), "r.stars", "r.contributors_count")


@query(GAINS_SQL + _GROWTH + "z AS (SELECT 1) SELECT id, contributors_week FROM grown")
def contributor_growth(spark, sf_dir):
    df = spark_view(spark, sf_dir, "entity").select("id", "contributors_count")
    return temporal.contributor_growth(df, spark_view(spark, sf_dir, "metrics"), F.date_sub(now_of(spark, sf_dir), 7)).select("id", "contributors_week")


_CURRENT = "cur AS (SELECT p_partkey AS id, s.stars + CASE WHEN p_partkey % 20 = 0 THEN 1 ELSE 0 END AS stars, s.forks, s.open_issues, s.forks * 2 AS watchers, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE s.forks END AS contributors_count FROM part JOIN span s ON s.id = p_partkey)"
_LAST = "lastrow AS (SELECT * FROM (SELECT m.*, row_number() OVER (PARTITION BY id ORDER BY recorded_on DESC) AS rn FROM metrics m, today WHERE recorded_on < now) t WHERE rn = 1)"


def _current(spark, sf_dir) -> DataFrame:
    span = spark_view(spark, sf_dir, "span")
    bump = F.when(F.col("id") % 20 == 0, 1).otherwise(0)
    return span.select(
        "id", (F.col("stars") + bump).alias("stars"), "forks", "open_issues", (F.col("forks") * 2).alias("watchers"), F.when(F.col("id") % 7 != 0, F.col("forks")).alias("contributors_count")
    )


@query(with_views("metrics", "today", "span").rstrip() + f", {_CURRENT}, {_LAST} SELECT c.id, c.stars, c.forks, c.open_issues, c.watchers, c.contributors_count FROM cur c LEFT JOIN lastrow l USING (id) WHERE l.id IS NULL OR c.stars IS DISTINCT FROM l.stars OR c.forks IS DISTINCT FROM l.forks OR c.open_issues IS DISTINCT FROM l.open_issues OR c.watchers IS DISTINCT FROM l.watchers OR c.contributors_count IS DISTINCT FROM l.contributors_count")
def snapshot_changes(spark, sf_dir):
    return temporal.changed_rows(_current(spark, sf_dir), spark_view(spark, sf_dir, "metrics"), now_of(spark, sf_dir)).drop("recorded_on")


@query(with_views("metrics", "today", "span").rstrip() + f", {_CURRENT} SELECT id, MAX(stars) AS stars, COUNT(*) AS n FROM (SELECT id, recorded_on, stars FROM metrics UNION ALL SELECT c.id, now, c.stars FROM cur c, today WHERE c.id % 20 = 0) t GROUP BY id")
def snapshot_write(spark, sf_dir):
    metrics, now = spark_view(spark, sf_dir, "metrics"), now_of(spark, sf_dir)
    rows = temporal.changed_rows(_current(spark, sf_dir), metrics, now)
    return temporal.write_snapshot(metrics, rows).groupBy("id").agg(F.max("stars").alias("stars"), F.count("*").alias("n"))


@query(SCORED_SQL + "SELECT id, trend_score, trend_velocity FROM scored")
def trend_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "trend_score", "trend_velocity")


@query(SCORED_SQL + "SELECT id, rel::DOUBLE * CASE WHEN is_archived THEN 0 ELSE 1 END AS release, idle::DOUBLE * CASE WHEN is_archived THEN 0 ELSE 1 END AS inactivity_penalty, 4.0::DOUBLE * dd * CASE WHEN is_archived THEN 0 ELSE 1 END AS daily FROM scored")
def trend_components(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "t.release", "t.inactivity_penalty", "t.daily")


@query(SCORED_SQL + "SELECT id, quality_score, quality_grade, license_class FROM scored")
def quality_scores(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "quality_score", "quality_grade", F.col("q.licence_class").alias("license_class"))


@query(SCORED_SQL + "SELECT id, " + ", ".join(f"ROUND({d} * 1000000) AS {d}" for d in scoring.DIMENSIONS) + " FROM scored")
def quality_dimensions(spark, sf_dir):
    return scored(spark, sf_dir).select("id", *[F.round(F.col(f"q.{d}") * 1000000).alias(d) for d in scoring.DIMENSIONS])


FLAGS_SQL = (
    "concat_ws('; ', CASE WHEN pushed_on IS NULL THEN 'last commit unknown' WHEN now - pushed_on > 365 THEN 'idle for more than a year' WHEN now - pushed_on > 180 THEN 'idle for more than six months' END, "
    "CASE WHEN released_on IS NULL THEN 'never released' WHEN now - released_on > 365 THEN 'last release over a year old' END, "
    "CASE WHEN top_contributor_share IS NOT NULL AND cc > 1 AND top_contributor_share >= 0.9 THEN 'one person does nearly all work' WHEN cc = 1 AND top_contributor_share IS NULL THEN 'only one contributor' END, "
    "CASE WHEN stars > 0 AND open_issues / stars::DOUBLE > 0.12 AND open_issues > 100 THEN 'many open issues for its audience' END, CASE WHEN rl < 500 THEN 'little or no readme' END, "
    "CASE license_class WHEN 'none' THEN 'no licence: reuse is not allowed' WHEN 'non-commercial' THEN 'licence limits commercial use' WHEN 'strong-copyleft' THEN 'strong copyleft: derived work must be opened' END, "
    "CASE WHEN is_archived THEN 'archived and read-only' END, CASE WHEN is_fork THEN 'is a fork' END)"
)


@query(SCORED_SQL + f"SELECT id, {FLAGS_SQL} AS flags FROM scored")
def quality_flags(spark, sf_dir):
    return scored(spark, sf_dir).select("id", F.array_join("quality_flags", "; ").alias("flags"))


@query(SCORED_SQL + f"SELECT COUNT(*) AS scored, COUNT(*) FILTER (quality_score <> id % 101) AS changed, COUNT(*) FILTER (quality_grade = 'A') AS grade_a, COUNT(*) FILTER (quality_grade = 'F') AS grade_f, COUNT(*) FILTER ({FLAGS_SQL} <> '') AS flagged FROM scored WHERE status = 'active'")
def score_pass_stats(spark, sf_dir):
    """Counted while the pass is written, without a second look at its rows."""
    figures, entity = scores.Figures(), spark_view(spark, sf_dir, "entity")
    new = scores.scored(entity, spark_view(spark, sf_dir, "metrics"), now_of(spark, sf_dir))
    stored = materialize(new.withColumn("quality_score", (F.col("id") % 101).cast("int")).drop("t", "q"), "stored")
    release(materialize(scores.changed(stored, spark_view(spark, sf_dir, "metrics"), now_of(spark, sf_dir), figures), "changed"))
    return spark.createDataFrame([figures.get()], "scored long, changed long, grade_a long, grade_f long, flagged long")


_SERIES = "pts AS (SELECT m.id, recorded_on, stars FROM metrics m, today WHERE recorded_on >= now - 90 UNION ALL SELECT id, recorded_on, stars FROM (SELECT m.*, row_number() OVER (PARTITION BY id ORDER BY recorded_on DESC) AS rn FROM metrics m, today WHERE recorded_on < now - 90) t WHERE rn = 1), ser AS (SELECT * FROM pts UNION ALL SELECT e.id, now, e.stars FROM entity e, today WHERE e.id IN (SELECT id FROM pts)) "


@query(with_views("metrics", "today", "entity").rstrip() + ", " + _SERIES + "SELECT id, CAST(recorded_on AS VARCHAR) AS day, stars FROM ser")
def metric_series(spark, sf_dir):
    points = temporal.series(spark_view(spark, sf_dir, "metrics"), spark_view(spark, sf_dir, "entity"), now_of(spark, sf_dir))
    return points.select("id", F.col("recorded_on").cast("string").alias("day"), "stars")


@query(with_views("metrics", "today", "entity").rstrip() + ", " + _SERIES + "SELECT id, CAST(recorded_on AS VARCHAR) AS day, FLOOR((stars - MIN(stars) OVER (PARTITION BY id)) / CASE WHEN MAX(stars) OVER (PARTITION BY id) = MIN(stars) OVER (PARTITION BY id) THEN 1 ELSE MAX(stars) OVER (PARTITION BY id) - MIN(stars) OVER (PARTITION BY id) END::DOUBLE * 1000000 + 0.5) AS at FROM ser")
def series_places(spark, sf_dir):
    points = temporal.series(spark_view(spark, sf_dir, "metrics"), spark_view(spark, sf_dir, "entity"), now_of(spark, sf_dir))
    return temporal.scaled(points).select("id", F.col("recorded_on").cast("string").alias("day"), F.floor(F.col("at") * 1000000 + 0.5).cast("double").alias("at"))


@query(with_views("metrics", "today", "entity").rstrip() + ", " + _SERIES + "SELECT id, MIN(stars) AS least, MAX(stars) AS most, arg_max(stars, recorded_on) - arg_min(stars, recorded_on) AS gained, COUNT(*) AS points, CASE WHEN MAX(stars) = MIN(stars) THEN 1 ELSE MAX(stars) - MIN(stars) END AS span, COUNT(*) >= 2 AS drawable FROM ser GROUP BY id")
def series_summary(spark, sf_dir):
    points = temporal.series(spark_view(spark, sf_dir, "metrics"), spark_view(spark, sf_dir, "entity"), now_of(spark, sf_dir))
    return temporal.series_summary(points)


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id AS key, COUNT(*) AS n, FLOOR(SUM(value) * 100 + 0.5) / 100 AS gained FROM events GROUP BY 1, 2")
def daily_gain(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("ts", F.col("user_id").alias("key"), "value")
    return observations.daily_gain(df).select(F.col("day").cast("string").alias("day"), "key", "n", scoring.fixed(F.col("gained"), 2).alias("gained"))


_LATE = "user_id % 10 = 3 AND CAST(ts AS DATE) < (SELECT MAX(CAST(ts AS DATE)) FROM events) - 5"


def _in_files(spark, sf_dir, *parts) -> tuple[str, StructType]:
    """Events as a folder of files that come one by one: key, ts and value of the rows of each condition."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
    folder = scratch_path(spark, "events")
    for part in parts:
        events.where(part).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken by the time of their writing
    return folder, events.schema


@query(
    "WITH closed AS (SELECT MAX(CAST(ts AS DATE)) - 1 AS last FROM events) "
    f"SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, user_id AS key, COUNT(*) AS n, FLOOR(SUM(value) * 100 + 0.5) / 100 AS gained FROM events, closed WHERE NOT ({_LATE}) AND CAST(ts AS DATE) < last GROUP BY 1, 2"
)
def streamed_gain(spark, sf_dir):
    """Days of a started stream that the watermark has closed; the rows of one file come days late and are left out."""
    last = table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("date"))).first()[0]
    late = (F.col("key") % 10 == 3) & (F.col("ts").cast("date") < F.date_sub(F.lit(last), 5))
    few = (F.col("key") % 10 == 7) & (F.col("ts").cast("date") == F.lit(last))
    folder, schema = _in_files(spark, sf_dir, ~late & ~few, few, late)  # a batch is held against the watermark of the one before
    work = scratch_path(spark, "stream")
    observations.run_files(spark, folder, schema, work, observations.daily_gain)
    out = spark.read.parquet(f"{work}/rows")
    return out.select(F.col("day").cast("string").alias("day"), "key", "n", scoring.fixed(F.col("gained"), 2).alias("gained"))


@query("SELECT user_id AS key, CAST(ts AS VARCHAR)[:19] AS ts, value FROM (SELECT *, LAG(value) OVER (PARTITION BY user_id ORDER BY ts, value) AS was FROM (SELECT user_id, ts, FLOOR(value / 40)::DOUBLE AS value FROM events) e) t WHERE was IS DISTINCT FROM value")
def streamed_changes(spark, sf_dir):
    """Values unlike the key's last, by a stream that is stopped behind the first file and started again."""
    middle = table(spark, sf_dir, "events").select(F.expr("percentile_approx(ts, 0.5)").alias("m")).first()["m"]
    work, shape = scratch_path(spark, "stream"), lambda rows: observations.changes(rows.withColumn("value", F.floor(F.col("value") / 40).cast("double")))
    folder, schema = _in_files(spark, sf_dir, F.col("ts") <= F.lit(middle))
    observations.run_files(spark, folder, schema, work, shape)
    events = table(spark, sf_dir, "events").where(F.col("ts") > F.lit(middle))
    events.select(F.col("user_id").cast("long").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value")).coalesce(1).write.mode("append").parquet(folder)
    observations.run_files(spark, folder, schema, work, shape)
    out = spark.read.parquet(f"{work}/rows")
    return out.select("key", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "value")
