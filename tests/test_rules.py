"""Hand-worked cases of the scoring, text and maintenance rules."""

import datetime as dt

from pyspark.sql import functions as F

from trendlake.functions import scoring, text
from trendlake.operators import merge, temporal

NOW = dt.datetime(2024, 6, 1)


def _trend(spark, **given):
    row = dict(stars=1000, day=0, week=0, people=None, released=None, pushed=NOW, created=NOW - dt.timedelta(days=900), archived=False) | given
    schema = "stars int, day int, week int, people int, released timestamp, pushed timestamp, created timestamp, archived boolean"
    df = spark.createDataFrame([tuple(row.values())], schema)
    return df.select(scoring.trend(*[F.col(c) for c in df.columns], F.lit(NOW)).alias("t")).first()["t"]


def test_trend_rules(spark):
    assert _trend(spark, day=5, week=20).score == 40.0
    assert _trend(spark, day=5, week=20, archived=True).score == 0.0
    assert _trend(spark, day=-5, week=-9).score == 0.0
    assert _trend(spark, pushed=NOW - dt.timedelta(days=366), week=400).inactivity_penalty == 250.0
    assert _trend(spark, pushed=NOW - dt.timedelta(days=30)).inactivity_penalty == 0.0
    assert _trend(spark, released=NOW - dt.timedelta(days=3)).release == 60.0
    assert _trend(spark, week=90, created=NOW - dt.timedelta(days=45)).novelty_bonus == 67.5
    assert _trend(spark, stars=30, week=10).velocity == 0.2


def test_licence_and_grade(spark):
    ids = [("MIT", "permissive"), (None, "none"), (" \t", "none"), ("NOASSERTION", "other"), ("CC-BY-NC-4.0", "other"), ("A-NC-1", "non-commercial"), ("AGPL-3.0", "strong-copyleft")]
    df = spark.createDataFrame(ids, "id string, want string")
    assert df.where(~scoring.licence_class(F.col("id")).eqNullSafe(F.col("want"))).count() == 0
    got = spark.createDataFrame([(s,) for s in (80, 79, 50, 35, 34)], "s int").select(scoring.grade(F.col("s"))).collect()
    assert [r[0] for r in got] == ["A", "B", "C", "D", "F"]


def test_phrases_keep_their_edges(spark):
    df = spark.createDataFrame([("storage rag", "rag"), ("storage", "rag"), ("fine   tuning", "fine-tuning"), ("fine, tuning", "fine-tuning")], "t string, p string")
    got = df.select("t", F.expr("1").alias("x"), text.phrase_pattern_column(F.col("p")).alias("p")).where(F.expr("t rlike p")).select("t").collect()
    assert [r[0] for r in got] == ["storage rag", "fine   tuning"]


def test_snapshot_rules(spark):
    day = dt.date(2024, 1, 1)
    schema = "id long, recorded_on date, stars long, forks long, open_issues long, watchers long, contributors_count long"
    metrics = spark.createDataFrame([(1, day, 5, 1, 1, 1, None), (2, day, 5, 1, 1, 1, 3)], schema)
    current = spark.createDataFrame([(1, 5, 1, 1, 1, None), (2, 5, 1, 1, 1, None), (3, 9, 0, 0, 0, None)], schema.replace("recorded_on date, ", ""))
    today = F.lit(day + dt.timedelta(days=2))
    rows = temporal.changed_rows(current, metrics, today)
    assert sorted(r.id for r in rows.collect()) == [2, 3]
    again = temporal.write_snapshot(temporal.write_snapshot(metrics, rows), rows)
    assert again.count() == 4
    assert {r.id: r.stars_week for r in temporal.deltas(current.select("id", "stars"), metrics, F.lit(day + dt.timedelta(days=7))).collect()} == {1: 0, 2: 0, 3: 0}


def test_dense_reading_agrees_with_as_of(spark):
    d = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    metrics = spark.createDataFrame([(1, d(0), 5), (1, d(3), 8)], "id long, recorded_on date, stars long")
    dense = temporal.dense(metrics, spark.createDataFrame([(d(4),)], "day date"))
    assert [r.stars for r in dense.orderBy("recorded_on").collect()] == [5, 5, 5, 8, 8]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", None)], "id long, name string, n int")
    new = spark.createDataFrame([(2, None, 7), (3, "c", 1)], "id long, name string, n int")
    once = merge.upsert(old, new, ["id"], {"name": "fill"}).select("id", "name", "n")
    twice = merge.upsert(once, new, ["id"], {"name": "fill"}).select("id", "name", "n")
    assert sorted(once.collect()) == sorted(twice.collect()) == [(1, "a", 5), (2, "b", 7), (3, "c", 1)]
