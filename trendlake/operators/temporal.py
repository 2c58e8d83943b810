"""Change-only snapshots: as-of reads, deltas, new rows and series.

A missing row means "unchanged since the last one". As-of reads are one grouped pass of filtered
``max_by`` (combined before the shuffle), not a lookup for each entity and date.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendlake.versions import Tables

COUNTERS = ["stars", "forks", "open_issues", "watchers", "contributors_count"]


def as_of(metrics: DataFrame, cutoffs: dict[str, Column], columns: list[str], key: str = "id", day: str = "recorded_on", strict: bool = False) -> DataFrame:
    """For each name in ``cutoffs`` a struct of the newest row at (strict: before) its date; null without."""
    row = F.struct(*columns, day)
    aggs = []
    for name, cutoff in cutoffs.items():
        seen = F.col(day) < cutoff if strict else F.col(day) <= cutoff
        aggs.append(F.max_by(F.when(seen, row), F.when(seen, F.col(day))).alias(name))
    return metrics.groupBy(key).agg(*aggs)


def deltas(current: DataFrame, metrics: DataFrame, today: Column) -> DataFrame:
    """``current(id, stars)`` with stars_day, stars_week and stars_month; no history gives 0."""
    before = as_of(metrics, {"d1": F.date_sub(today, 1), "d7": F.date_sub(today, 7), "d30": F.date_sub(today, 30)}, ["stars"])
    joined = current.join(before, "id", "left")
    gain = lambda c: F.coalesce(F.col("stars") - F.col(c)["stars"], F.lit(0))
    return joined.select(*current.columns, gain("d1").alias("stars_day"), gain("d7").alias("stars_week"), gain("d30").alias("stars_month"))


def months_back(today: date, days: int = 30) -> list[str]:
    """The months, as ``yyyy-MM``, that the last ``days`` and ``today`` fall into."""
    at, out = (today - timedelta(days=days)).replace(day=1), []
    while at <= today:
        out.append(f"{at:%Y-%m}")
        at = (at + timedelta(days=32)).replace(day=1)
    return out


def anchors(month: str, metrics: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The newest row of each entity before ``month``: of ``metrics``, or of the one month before it and that month's anchors ``before``.

    With anchors kept for each month a reading of the last days never goes further back, however long the history is.
    """
    first = F.lit(f"{month}-01").cast("date")
    rows = metrics.where(F.col("recorded_on") < first).drop("month")
    if before is not None:
        rows = rows.unionByName(before.drop("month"))
    newest = rows.groupBy("id").agg(F.max_by(F.struct(*rows.columns), "recorded_on").alias("r"))
    return newest.select("r.*").withColumn("month", F.lit(month))


def stored_deltas(tables: Tables, current: DataFrame, today: date) -> DataFrame:
    """:func:`deltas` from the stored tables ``metrics`` and ``anchor``: the months of the last 30 days and one anchor an entity are read."""
    months = months_back(today)
    recent = tables.read("metrics", only={"month": months}).drop("month")
    anchor = tables.read("anchor", only={"month": months[:1]}).drop("month")
    return deltas(current, recent.unionByName(anchor.select(*recent.columns)), F.lit(today))


def contributor_growth(current: DataFrame, metrics: DataFrame, cutoff: Column) -> DataFrame:
    """``current(id, contributors_count)`` with the week's growth; an unknown side counts as none."""
    before = as_of(metrics, {"then": cutoff}, ["contributors_count"])
    grown = F.greatest(F.col("contributors_count") - F.col("then")["contributors_count"], F.lit(0))
    return current.join(before, "id", "left").select(*current.columns, F.coalesce(grown, F.lit(0)).alias("contributors_week"))


def week_and_gains(current: DataFrame, metrics: DataFrame, today: Column) -> DataFrame:
    """``current(id, stars, contributors_count, ...)`` with :func:`deltas` and :func:`contributor_growth`, by one pass over the metrics."""
    before = as_of(metrics, {"d1": F.date_sub(today, 1), "d7": F.date_sub(today, 7), "d30": F.date_sub(today, 30)}, ["stars", "contributors_count"])
    gain = lambda c: F.coalesce(F.col("stars") - F.col(c)["stars"], F.lit(0))
    grown = F.greatest(F.col("contributors_count") - F.col("d7")["contributors_count"], F.lit(0))
    grown = F.when(F.col("contributors_count").isNull() | F.col("d7")["contributors_count"].isNull(), 0).otherwise(grown)
    more = {"stars_day": gain("d1"), "stars_week": gain("d7"), "stars_month": gain("d30"), "contributors_week": grown}
    joined = current.drop(*more).join(before, "id", "left")
    return joined.select(*[c for c in current.columns if c not in more], *[v.alias(k) for k, v in more.items()])


def changed_rows(current: DataFrame, metrics: DataFrame, today: Column, force: bool = False) -> DataFrame:
    """Snapshot rows to write for ``today``: forced, first ones, or any counter unlike the newest before."""
    last = as_of(metrics, {"last": today}, COUNTERS, strict=True)
    joined = current.join(last, "id", "left")
    differs = F.lit(force) | F.col("last").isNull()
    for c in COUNTERS:
        differs = differs | ~F.col(c).eqNullSafe(F.col("last")[c])
    return joined.where(differs).select("id", today.alias("recorded_on"), *COUNTERS)


def write_snapshot(metrics: DataFrame, rows: DataFrame) -> DataFrame:
    """The next version of the table: rows of the same entity and day are overwritten."""
    kept = metrics.join(rows.select("id", "recorded_on"), ["id", "recorded_on"], "left_anti")
    return kept.unionByName(rows.select(*metrics.columns))


def series(metrics: DataFrame, current: DataFrame, today: Column, days: int = 90) -> DataFrame:
    """Points of the last ``days`` with the anchor before them, and the current values as today's point.

    Only entities with at least one row get a point for today, and only where there is none yet. The metrics are
    grouped once: older rows leave only the newest of them, the last ``days`` at most a row a day.
    """
    start, row = F.date_sub(today, days), F.struct("recorded_on", *COUNTERS)
    old = F.col("recorded_on") < start
    own = metrics.groupBy("id").agg(F.max_by(F.when(old, row), F.when(old, F.col("recorded_on"))).alias("anchor"), F.collect_list(F.when(~old, row)).alias("recent"), F.max("recorded_on").alias("newest"))
    values = [F.col(c).cast("long") if c != "contributors_count" and c in current.columns else F.lit(None).cast("long") for c in COUNTERS]
    now = current.select("id", F.struct(today.alias("recorded_on"), *[v.alias(c) for v, c in zip(values, COUNTERS, strict=True)]).alias("now"))
    both = own.join(now, "id", "left")
    points = F.concat(F.array("anchor"), F.col("recent"), F.array(F.when(F.col("newest") < today, F.col("now"))))
    return both.select("id", F.explode(F.array_compact(points)).alias("p")).select("id", "p.recorded_on", *[f"p.{c}" for c in COUNTERS])


def series_summary(points: DataFrame, column: str = "stars") -> DataFrame:
    """Per entity: least, most, span (at least 1), gain, number of points and whether they make a line."""
    s = points.groupBy("id").agg(
        F.min(column).alias("least"),
        F.max(column).alias("most"),
        (F.max_by(column, "recorded_on") - F.min_by(column, "recorded_on")).alias("gained"),
        F.count("*").alias("points"),
    )
    span = F.col("most") - F.col("least")
    return s.withColumn("span", F.when(span == 0, 1).otherwise(span)).withColumn("drawable", F.col("points") >= 2)


def scaled(points: DataFrame, column: str = "stars") -> DataFrame:
    """Points with their place between the entity's least (0) and most (1) value; 0 where all are equal."""
    w = Window.partitionBy("id")
    low, high = F.min(column).over(w), F.max(column).over(w)
    return points.withColumn("at", (F.col(column) - low) / F.when(high == low, 1).otherwise(high - low))


def dense(metrics: DataFrame, days: DataFrame) -> DataFrame:
    """A value for each entity and each day since its first row, carried forward from the sparse rows."""
    bounds = metrics.groupBy("id").agg(F.min("recorded_on").alias("first"))
    grid = bounds.select("id", F.explode(F.sequence("first", F.lit(days.agg(F.max("day")).first()[0]))).alias("recorded_on"))
    w = Window.partitionBy("id").orderBy("recorded_on").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(metrics.select("id", "recorded_on", "stars"), ["id", "recorded_on"], "left")
    return filled.withColumn("stars", F.last("stars", ignorenulls=True).over(w))
