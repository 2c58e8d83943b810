"""Free-text locations to country and city, by the caller's alias and non-place tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlake.functions.text import flag_code, plain_location

ALIAS_LIMIT = 100_000
# Fixed value: what stands between the places that someone moved through.
HOPS = r"\s*(?:->|→|=>|\||/)\s*"


def resolve(people: DataFrame, aliases: DataFrame, non_places: DataFrame, key: str = "id", raw: str = "location") -> DataFrame:
    """key, country, city. The last known segment wins, two segments before one; then a flag; never a guess.

    ``aliases(alias, country)`` and ``non_places(value)`` hold lower-case texts and are broadcast
    up to ``ALIAS_LIMIT`` rows.
    """
    hint = F.broadcast if aliases.limit(ALIAS_LIMIT + 1).count() <= ALIAS_LIMIT else lambda d: d
    text = plain_location(F.coalesce(F.col(raw), F.lit("")))
    hops = F.filter(F.split(text, HOPS), lambda h: h != "")
    current = F.when(F.size(hops) > 1, F.element_at(hops, -1)).otherwise(text)
    parts = F.filter(F.transform(F.split(current, ","), lambda s: F.trim(s)), lambda s: s != "")
    base = people.select(key, flag_code(F.coalesce(F.col(raw), F.lit(""))).alias("flag"), F.lower(text).alias("whole"), parts.alias("parts"))
    base = base.join(hint(non_places.select(F.col("value").alias("whole"), F.lit(True).alias("nowhere"))), "whole", "left")
    base = base.withColumn("open", (F.col("whole") != "") & F.col("nowhere").isNull())

    lower = F.transform("parts", lambda s: F.lower(s))
    tail = lambda i: F.array_join(F.slice(lower, F.greatest(i, F.lit(1)), F.size("parts")), ", ")
    # candidates in order of preference: from the right, the longer text before the segment, the whole text last
    tries = F.flatten(
        F.transform(
            F.when(F.size("parts") > 0, F.reverse(F.sequence(F.lit(0), F.size("parts") - 1))).otherwise(F.array().cast("array<int>")),
            lambda i: F.array(F.struct(i.alias("at"), tail(i).alias("alias")), F.struct(i.alias("at"), F.get(lower, i).alias("alias"))),
        )
    )
    tries = F.concat(tries, F.array(F.struct(F.lit(-1).alias("at"), F.col("whole").alias("alias"))))
    found = base.where("open").select(key, "parts", F.posexplode(tries).alias("n", "t")).select(key, "parts", "n", "t.at", "t.alias")
    found = found.join(hint(aliases), "alias")
    best = found.groupBy(key).agg(F.min_by(F.struct("country", "at"), "n").alias("hit"))
    by_flag = aliases.select(F.col("alias").alias("flag"), F.col("country").alias("by_flag"))
    out = base.join(best, key, "left").join(hint(by_flag), "flag", "left")
    first = F.get("parts", F.lit(0))
    at = F.col("hit.at")
    city = (
        F.when(~F.col("open"), None)
        .when(F.col("hit").isNull(), first)
        .when((F.size("parts") > 1) & ((at < 0) | (F.lower(first) != F.lower(F.get("parts", at)))), first)
    )
    return out.select(key, F.coalesce("hit.country", "by_flag").alias("country"), city.alias("city"))


def backfill(entities: DataFrame, resolved: DataFrame) -> DataFrame:
    """Owner countries set where a location resolves; the others keep theirs."""
    fresh = resolved.select("id", F.col("country").alias("__new"))
    return entities.join(fresh, "id", "left").withColumn("owner_country", F.coalesce("__new", "owner_country")).drop("__new")
