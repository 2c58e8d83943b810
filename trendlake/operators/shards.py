"""Splitting a table into shards under a cap, planned over a small histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlake.operators import merge
from trendlake.storage import materialize, release


KEYS = ["topic", "stars_lo", "stars_hi", "created_from", "created_to"]


def plan(rows: DataFrame, cap: int, lo: int, hi: int, created_from: str, created_to: str, rounds: int = 64) -> DataFrame:
    """Shards (topic, stars_lo, stars_hi, created_from, created_to, total, status) over ``rows(topic, stars, day)``.

    A shard over ``cap`` is split, stars first at their geometric middle, then dates down to one
    day; what cannot be split is ``unsplittable`` with the shortfall. The rows become a histogram of (topic, stars, day)
    whose cells carry the bounds of their shard: a round is one grouped sum, and each cell of a shard that
    splits moves its own bounds, so no round compares cells with shards by range. Cells of finished
    shards leave; halves without cells are done with none.
    """
    cells = rows.groupBy("topic", "stars", "day").agg(F.count("*").alias("n"))
    bounds = {"stars_lo": F.lit(lo).cast("long"), "stars_hi": F.lit(hi).cast("long"), "created_from": F.lit(created_from).cast("date"), "created_to": F.lit(created_to).cast("date")}
    cells = cells.withColumns(bounds)
    inside = F.col("stars").between(F.col("stars_lo"), F.col("stars_hi")) & F.col("day").between(F.col("created_from"), F.col("created_to"))
    cells = materialize(cells.withColumn("n", F.when(inside, F.col("n")).otherwise(0)), "cells")  # a topic outside has a shard too
    asked, done = None, []
    by_stars, by_day = F.col("stars_lo") < F.col("stars_hi"), F.col("created_from") < F.col("created_to")
    middle = F.least(F.greatest(F.floor(F.sqrt(F.greatest("stars_lo", F.lit(1)) * F.col("stars_hi"))), F.col("stars_lo")), F.col("stars_hi") - 1)
    half = F.date_add("created_from", F.floor(F.datediff("created_to", "created_from") / 2).cast("int"))
    for _ in range(rounds):
        counted = cells.groupBy(*KEYS).agg(F.sum("n").alias("total"))
        if asked is not None:
            counted = asked.join(counted, KEYS, "left").withColumn("total", F.coalesce("total", F.lit(0)))
        status = F.when(F.col("total") <= cap, "done").when(by_stars | by_day, "split").otherwise("unsplittable")
        counted = materialize(counted.withColumn("status", status), "shards")
        done.append(counted)
        split = counted.where("status = 'split'")
        if split.isEmpty():
            break
        halves = F.when(
            by_stars,
            F.array(F.struct(F.col("stars_lo").alias("a"), middle.alias("b"), F.col("created_from").alias("f"), F.col("created_to").alias("t")), F.struct((middle + 1).alias("a"), F.col("stars_hi").alias("b"), F.col("created_from").alias("f"), F.col("created_to").alias("t"))),
        ).otherwise(
            F.array(F.struct(F.col("stars_lo").alias("a"), F.col("stars_hi").alias("b"), F.col("created_from").alias("f"), half.alias("t")), F.struct(F.col("stars_lo").alias("a"), F.col("stars_hi").alias("b"), F.date_add(half, 1).alias("f"), F.col("created_to").alias("t")))
        )
        asked = split.select("topic", F.explode(halves).alias("h")).select("topic", F.col("h.a").alias("stars_lo"), F.col("h.b").alias("stars_hi"), F.col("h.f").alias("created_from"), F.col("h.t").alias("created_to"))
        low, early = F.col("stars") <= middle, F.col("day") <= half
        moved = {
            "stars_lo": F.when(by_stars & ~low, middle + 1).otherwise(F.col("stars_lo")), "stars_hi": F.when(by_stars & low, middle).otherwise(F.col("stars_hi")),
            "created_from": F.when(~by_stars & ~early, F.date_add(half, 1)).otherwise(F.col("created_from")), "created_to": F.when(~by_stars & early, half).otherwise(F.col("created_to")),
        }
        open_ = cells.where("n > 0").join(split.select(*KEYS), KEYS, "left_semi")
        following = materialize(open_.select("topic", "stars", "day", "n", *[c.alias(k) for k, c in moved.items()]), "cells")
        release(cells)
        cells = following
    else:
        raise RuntimeError("shards still split after the last round")
    out = done[0].where("status <> 'split'")
    for d in done[1:]:
        out = out.unionByName(d.where("status <> 'split'"))
    release(cells)
    return out.withColumn("shortfall", F.greatest(F.col("total") - cap, F.lit(0)))



def work_list(shards: DataFrame, seeds: DataFrame, floor: int, ceiling: int, created_from: str, created_to: str) -> DataFrame:
    """Open shards of the seeds at or above the floor, and a root shard for each seed that has none for this window."""
    mine = shards.join(seeds.select("topic"), "topic", "left_semi")
    window = {"created_from": F.lit(created_from).cast("date"), "created_to": F.lit(created_to).cast("date")}
    todo = mine.where(F.col("status").isin("pending", "error") & (F.col("stars_lo") >= floor))
    todo = todo.select("topic", "stars_lo", "stars_hi", *[F.coalesce(c, v).alias(c) for c, v in window.items()])
    root = (F.col("stars_lo") == floor) & (F.col("stars_hi") == ceiling)
    for c, v in window.items():
        root &= F.col(c) == v
    fresh = seeds.join(mine.where(root).select("topic"), "topic", "left_anti")
    fresh = fresh.select("topic", F.lit(floor).cast("long").alias("stars_lo"), F.lit(ceiling).cast("long").alias("stars_hi"), *[v.alias(c) for c, v in window.items()])
    return todo.unionByName(fresh).distinct()


def record(shards: DataFrame, new: DataFrame) -> DataFrame:
    """Shards after ``new`` states of some: a known total and the greatest number fetched stay, all else is new."""
    return merge.upsert(shards, new, KEYS, {"total": "fill", "fetched": "most"}).select(*shards.columns)
