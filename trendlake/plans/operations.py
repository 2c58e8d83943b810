"""Queries on intake, refresh, people, shards and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendlake.operators import listing, people, places, refresh, scores, shards
from trendlake.plans import growth
from trendlake.plans.catalogue import ALL_SQL, stored_scores
from trendlake.plans.growth import now_of
from trendlake.plans.registry import query
from trendlake.plans.views import spark_view, table, with_views
from trendlake.sources import payloads
from trendlake.storage import materialize, scratch_path
from trendlake.versions import Tables


@query(with_views("entity") + "SELECT id, CASE WHEN id % 4 = 1 THEN 'new/' || id WHEN id % 4 = 2 THEN upper(full_name) ELSE full_name END AS found, id % 4 IN (1, 2) AS renamed FROM entity WHERE id % 4 <> 3 AND id % 8 <> 6")
def resolved_entities(spark, sf_dir):
    """By stable id, renamed by stable id, by name in capitals, not fetched, by a name that none has."""
    e = spark_view(spark, sf_dir, "entity").select("id", "github_id", "full_name")
    text_id = F.col("id").cast("string")
    name = F.when(F.col("id") % 4 == 1, F.concat(F.lit("new/"), text_id)).when(F.col("id") % 8 == 6, F.concat(F.lit("none/"), text_id)).when(F.col("id") % 4 == 2, F.upper("full_name")).otherwise(F.col("full_name"))
    stable = F.when(F.col("id") % 4 != 2, F.col("github_id"))
    fetched = e.where("id % 4 <> 3").select(stable.alias("github_id"), name.alias("full_name"))
    return refresh.resolve(e, fetched).select("id", F.col("fetched.full_name").alias("found"), "renamed")


@query(with_views("entity", "today") + "SELECT id, CASE WHEN id % 5 = 0 OR (id % 5 = 1 AND status = 'active') THEN now ELSE synced_on END::VARCHAR AS synced_on, CASE WHEN id % 5 = 1 AND status = 'active' THEN 'rejected' ELSE status END AS status FROM entity, today")
def stamped_entities(spark, sf_dir):
    e = spark_view(spark, sf_dir, "entity")
    out = refresh.stamp(e.join(spark_view(spark, sf_dir, "today")), e.where("id % 5 = 0"), e.where("id % 5 = 1"), F.col("now"))
    return out.select("id", F.col("synced_on").cast("string").alias("synced_on"), "status")


@query(with_views("entity") + "SELECT id FROM entity WHERE readme_length IS NULL AND id % 2 = 0 ORDER BY id LIMIT 200")
def readme_queue(spark, sf_dir):
    e = spark_view(spark, sf_dir, "entity")
    return refresh.readme_queue(e, e.where("id % 2 = 0")).select("id")


def _people(spark, sf_dir):
    """Person with a stable id and an avatar, and what was found: half of the suppliers, shifted by 50."""
    p = spark_view(spark, sf_dir, "person").select("id", (F.col("id") + 1000).alias("github_id"), "login", F.lit("old.png").alias("avatar_url"))
    f = spark_view(spark, sf_dir, "link").select("entity_id", (F.col("person_id") + 1050).alias("github_id"), F.concat(F.lit("s"), "person_id").alias("login"), F.when(F.col("person_id") % 2 == 0, "new.png").alias("avatar_url"), "contributions")
    return p, f


_MOVED = (
    "f AS (SELECT entity_id, person_id + 1050 AS github_id, 's' || person_id AS login, CASE WHEN person_id % 2 = 0 THEN 'new.png' END AS avatar_url, contributions FROM link), "
    "folk AS (SELECT DISTINCT github_id, login, avatar_url FROM f), top AS (SELECT MAX(id) AS top FROM person) "
)


@query(
    with_views("person", "link").rstrip() + ", " + _MOVED + "SELECT p.id, COALESCE(folk.login, p.login) AS login, COALESCE(avatar_url, 'old.png') AS avatar_url FROM person p LEFT JOIN folk ON folk.github_id = p.id + 1000 "
    "UNION ALL SELECT top + github_id + 1, login, avatar_url FROM folk, top WHERE github_id NOT IN (SELECT id + 1000 FROM person)"
)
def persisted_people(spark, sf_dir):
    p, f = _people(spark, sf_dir)
    e, k = spark_view(spark, sf_dir, "entity"), people.ranked(spark_view(spark, sf_dir, "link"))
    return refresh.persist_people(p, k, e, f)[0].select("id", "login", "avatar_url")


@query(
    with_views("person", "link").rstrip() + ", " + _MOVED + ", own AS (SELECT entity_id, COALESCE(p.id, top + f.github_id + 1) AS person_id, contributions FROM f CROSS JOIN top LEFT JOIN person p ON p.id + 1000 = f.github_id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY contributions DESC, person_id) AS rank FROM own), old AS (SELECT entity_id, person_id, contributions, row_number() OVER (PARTITION BY entity_id ORDER BY contributions DESC, person_id) AS rank FROM link) "
    "SELECT * FROM r WHERE rank <= 30 UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM r WHERE rank <= 30 AND r.entity_id = old.entity_id AND r.person_id = old.person_id)"
)
def persisted_links(spark, sf_dir):
    p, f = _people(spark, sf_dir)
    e, k = spark_view(spark, sf_dir, "entity"), people.ranked(spark_view(spark, sf_dir, "link"))
    return refresh.persist_people(p, k, e, f)[1].select("entity_id", "person_id", "contributions", F.col("rank").cast("long").alias("rank"))


@query(
    with_views("entity").rstrip() + ", f AS (SELECT l_orderkey % 50 AS id, l_orderkey AS person, SUM(l_linenumber) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, person) AS rn FROM f), "
    "g AS (SELECT id, COUNT(*) AS c, FLOOR(MAX(n) / SUM(n)::DOUBLE * 10000 + 0.5) / 10000 AS share FROM t WHERE rn <= 100 GROUP BY id) "
    "SELECT e.id, CASE WHEN g.c >= 100 THEN 250 + e.id ELSE COALESCE(g.c, e.contributors_count) END::BIGINT AS contributors_count, CASE WHEN g.id IS NOT NULL THEN share ELSE e.top_contributor_share END AS top_contributor_share FROM entity e LEFT JOIN g ON g.id = e.id"
)
def people_aggregates(spark, sf_dir):
    """Full lists of a hundred people and more take the measured lower bound."""
    li = table(spark, sf_dir, "lineitem")
    f = li.groupBy((F.col("l_orderkey") % 50).alias("entity_id"), (F.col("l_orderkey") + 1).alias("github_id")).agg(F.sum("l_linenumber").alias("contributions"))
    f = f.withColumns({"login": F.concat(F.lit("o"), "github_id"), "avatar_url": F.lit(None).cast("string")})
    p = spark.createDataFrame([], "id long, github_id long, login string, avatar_url string")
    k = spark.createDataFrame([], "entity_id long, person_id long, contributions long, rank int")
    measured = f.select("entity_id").distinct().withColumn("count", F.col("entity_id") + 250)
    e = refresh.persist_people(p, k, spark_view(spark, sf_dir, "entity"), f, measured)[2]
    return e.select("id", F.col("contributors_count").cast("long").alias("contributors_count"), "top_contributor_share")


def _aliases(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    return nation.select(F.lower(F.translate("n_name", "_", " ")).alias("alias"), F.col("n_name").alias("country")), spark.createDataFrame([("remote",)], "value string")


@query(with_views("person") + "SELECT id, CASE WHEN id % 2 = 0 THEN 'NATION_3' WHEN id % 4 = 1 THEN NULL ELSE country END AS country, CASE WHEN id % 2 = 0 THEN 'Town' END AS city, CASE WHEN id % 4 = 3 THEN followers ELSE id END AS followers, CASE WHEN id % 4 = 3 THEN synced_on ELSE DATE '2024-05-01' END::VARCHAR AS synced_on FROM person")
def refreshed_profiles(spark, sf_dir):
    """Half of the people give a place, a quarter one that is none, a quarter are not fetched."""
    p = spark_view(spark, sf_dir, "person").withColumn("city", F.lit(None).cast("string"))
    place = F.when(F.col("id") % 2 == 0, "Town, Nation 3").otherwise("Remote")
    got = p.where("id % 4 <> 3").select((F.col("id") + 9).alias("id"), "login", place.alias("location"), F.col("id").alias("followers"))
    out = refresh.refresh_profiles(p, got, *_aliases(spark, sf_dir), F.lit("2024-05-01").cast("date"))
    return out.select("id", "country", "city", "followers", F.col("synced_on").cast("string").alias("synced_on"))


@query(with_views("entity") + "SELECT id, CASE id % 3 WHEN 0 THEN 'NATION_5' ELSE owner_country END AS owner_country FROM entity")
def country_backfill(spark, sf_dir):
    e = spark_view(spark, sf_dir, "entity")
    place = F.when(F.col("id") % 3 == 0, "Nation 5").when(F.col("id") % 3 == 1, "no such place")
    found = places.resolve(e.select("id", place.alias("location")), *_aliases(spark, sf_dir))
    return places.backfill(e, found).select("id", "owner_country")


@query(
    with_views("category").rstrip() + ", n AS (SELECT 'brand-' || p_brand AS slug, CASE WHEN p_brand < 'Brand#2' THEN 'a' ELSE 'x' END AS group_slug, COUNT(*) AS place FROM part GROUP BY p_brand) "
    "SELECT slug, group_slug, CASE WHEN group_slug = 'a' THEN 1000 ELSE 99000 END + place AS sort_order FROM n UNION ALL SELECT slug, 'a', 1000 FROM category WHERE slug = 'unused' UNION ALL SELECT slug, group_slug, sort_order FROM category WHERE slug <> 'unused'"
)
def seeded_categories(spark, sf_dir):
    group = F.when(F.col("p_brand") < "Brand#2", "a").otherwise("x")
    new = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("brand-"), "p_brand").alias("slug"), group.alias("group_slug")).agg(F.count("*").alias("place"))
    new = new.unionByName(spark.createDataFrame([("unused", "a", 0)], "slug string, group_slug string, place long"))
    return refresh.seed_categories(spark_view(spark, sf_dir, "category"), spark.createDataFrame([("b", 0), ("a", 1)], "group_slug string, place int"), new)


@query("SELECT 'own/Name' || p_size AS full_name, 'own' AS owner_login, 'manual:add' AS discovery_source FROM part GROUP BY p_size")
def named_intake(spark, sf_dir):
    """Each name in three spellings, and some that are none."""
    size = F.col("p_size").cast("string")
    forms = F.array(F.concat(F.lit("own/Name"), size), F.concat(F.lit("https://github.com/OWN/name"), size), F.concat(F.lit("git@github.com:own/Name"), size, F.lit(".git")), F.lit("no such"))
    good, bad = refresh.named_intake(table(spark, sf_dir, "part").select(F.explode(forms).alias("raw")))
    return good.select(F.concat(F.lit("own/Name"), F.substring("full_name", 9, 99)).alias("full_name"), F.lower("owner_login").alias("owner_login"), "discovery_source").join(bad.limit(1).select(F.lit(1).alias("some"))).drop("some")


_SHARD = "s AS (SELECT 'src' || s_suppkey % 20 AS topic, s_suppkey AS stars_lo, s_suppkey + 10 AS stars_hi, CASE s_suppkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'error' WHEN 2 THEN 'done' ELSE 'split' END AS status FROM supplier)"


def _shards(spark, sf_dir):
    k = F.col("s_suppkey").cast("long")
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending", "error", "done", "split")]), (k % 4 + 1).cast("int"))
    day = F.lit("2020-01-01").cast("date")
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("src"), k % 20).alias("topic"), k.alias("stars_lo"), (k + 10).alias("stars_hi"), day.alias("created_from"), F.lit(None).cast("date").alias("created_to"), status.alias("status"), F.when(k % 3 == 0, k).alias("total"), k.alias("fetched"))


@query(f"WITH {_SHARD} SELECT topic, stars_lo, stars_hi FROM s WHERE status IN ('pending', 'error') AND stars_lo >= 10 AND topic <> 'src7' UNION ALL SELECT DISTINCT source, 10, 1000 FROM documents WHERE source <> 'src7'")
def shard_work(spark, sf_dir):
    """Open shards of the seeds above the floor, and a root for every seed, as none has one yet."""
    seeds = table(spark, sf_dir, "documents").select(F.col("source").alias("topic")).where("topic <> 'src7'").distinct()
    known = _shards(spark, sf_dir)
    extra = known.select("topic").distinct().join(seeds, "topic", "left_anti").where("topic <> 'src7'")
    out = shards.work_list(known, seeds.unionByName(extra), 10, 1000, "2020-01-01", "2021-01-01")
    return out.join(extra, "topic", "left_anti").select("topic", "stars_lo", "stars_hi").unionByName(out.join(extra, "topic", "left_semi").where("stars_hi < 1000").select("topic", "stars_lo", "stars_hi"))


@query("SELECT s_suppkey AS stars_lo, CASE WHEN s_suppkey % 2 = 0 THEN 'done' ELSE CASE s_suppkey % 4 WHEN 1 THEN 'error' ELSE 'split' END END AS status, CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 4 = 0 THEN 7 WHEN s_suppkey % 3 = 0 THEN s_suppkey END AS total, CASE WHEN s_suppkey % 2 = 0 THEN GREATEST(s_suppkey, 40) ELSE s_suppkey END AS fetched FROM supplier")
def shard_records(spark, sf_dir):
    old = _shards(spark, sf_dir).withColumn("created_to", F.lit("2021-01-01").cast("date"))
    new = old.where("stars_lo % 2 = 0").select(*shards.KEYS, F.lit("done").alias("status"), F.when(F.col("stars_lo") % 4 == 0, 7).cast("long").alias("total"), F.lit(40).cast("long").alias("fetched"))
    return shards.record(old, new).select("stars_lo", "status", "total", "fetched")


@query(with_views("entity") + "SELECT COUNT(*) FILTER (status = 'active') AS total, 3 AS page, 50 AS per_page, CEIL(COUNT(*) FILTER (status = 'active') / 50.0)::BIGINT AS total_pages, 101 AS start_rank, (SELECT string_agg(id, ',' ORDER BY stars DESC, id DESC) FROM (SELECT * FROM entity WHERE status = 'active' ORDER BY stars DESC, id DESC LIMIT 50 OFFSET 100)) AS ids FROM entity")
def page_frames(spark, sf_dir):
    e = spark_view(spark, sf_dir, "entity").where("status = 'active'").select("id", "stars")
    out = listing.page_frame(e, [F.desc("stars"), F.desc("id")], 3, 50)
    return out.withColumn("ids", F.array_join(F.col("items.id").cast("array<string>"), ",")).drop("items")


@query(with_views("entity") + "SELECT COUNT(*) FILTER (status = 'active') AS total, 90000 AS page, 100 AS per_page, 0 AS items FROM entity")
def page_past_the_end(spark, sf_dir):
    e = spark_view(spark, sf_dir, "entity").where("status = 'active'").select("id", "stars")
    return listing.page_frame(e, [F.desc("id")], 90_000, 500).select("total", "page", "per_page", F.size("items").alias("items"))


@query(
    with_views("entity", "assignment") + "SELECT 'all' AS facet, 'all' AS value, COUNT(*) AS n FROM entity WHERE status = 'active' UNION ALL SELECT 'language', language, COUNT(*) FROM entity WHERE status = 'active' GROUP BY language UNION ALL "
    "SELECT 'country', owner_country, COUNT(*) FROM entity WHERE status = 'active' AND owner_country IS NOT NULL GROUP BY owner_country UNION ALL SELECT 'category', slug, COUNT(*) FROM assignment a JOIN entity e ON e.id = a.entity_id WHERE is_primary AND status = 'active' GROUP BY slug"
)
def explorer_facets(spark, sf_dir):
    return listing.facets(spark_view(spark, sf_dir, "entity"), spark_view(spark, sf_dir, "assignment"))


def _top(name: str, order: str, more: str = "") -> str:
    return f"SELECT '{name}' AS list, row_number() OVER (ORDER BY {order} DESC NULLS LAST, id DESC) AS place, id FROM scored WHERE status = 'active' AND NOT is_archived {more} QUALIFY place <= 8"


@query(ALL_SQL + " UNION ALL ".join([_top("trending-day", "stars_day"), _top("trending-week", "stars_week"), _top("newest", "created_on"), _top("quality", "quality_score", "AND quality_score >= 60")]))
def home_lists(spark, sf_dir):
    return listing.home(stored_scores(spark, sf_dir))


@query("SELECT p_partkey AS github_id, 'o' || p_partkey % 7 AS owner_login, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE 'x,y' END AS topics, CASE WHEN p_size % 2 = 0 THEN '2024-01-02' ELSE '2023-03-04' END AS released_on, CASE p_size % 4 WHEN 0 THEN NULL ELSE p_size % 4 - 1 END AS releases, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_name END AS readme, 0 AS watchers FROM part")
def nested_payloads(spark, sf_dir):
    p, k, size = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    null = F.lit(None).cast("string")
    topic = lambda t: F.struct(F.struct(t.alias("name")).alias("topic"))
    topics = F.slice(F.array(topic(null), topic(F.lit("x")), topic(F.lit("y"))), 1, (size % 3 + 1).cast("int"))
    release = lambda draft, at: F.struct(F.lit(draft).alias("isDraft"), null.alias("publishedAt"), F.lit(at).alias("createdAt"))
    fresh = F.slice(F.array(release(True, "2024-05-01"), *[release(False, "2024-05-01")] * 3), 1, (size % 4).cast("int"))
    releases = F.when(size % 4 != 0, F.struct(F.concat(fresh, F.array(release(False, "2020-01-01"))).alias("nodes")))
    text = lambda t, b: F.struct(t.alias("text"), F.lit(b).alias("isBinary"))
    readmes = F.array(text(F.lit("binary"), True), text(F.lit(""), False), text(F.when(size % 5 != 0, F.col("p_name")), False))
    latest = F.struct(F.when(size % 2 == 0, "2024-01-02T00:00:00Z").alias("publishedAt"), F.lit("2023-03-04T00:00:00Z").alias("createdAt"))
    item = F.struct(
        k.alias("databaseId"), F.concat(F.lit("o"), (k % 7).cast("string"), F.lit("/n")).alias("nameWithOwner"), F.struct(topics.alias("nodes")).alias("repositoryTopics"),
        latest.alias("latestRelease"), releases.alias("releases"), readmes.alias("readmes"),
    )
    out = payloads.nested(p.select(F.to_json(item).alias("body")), F.lit("2024-06-01").cast("timestamp"))
    day = F.date_format("released_at", "yyyy-MM-dd")
    return out.select("github_id", "owner_login", F.array_join("topics", ",").alias("topics"), day.alias("released_on"), F.col("releases_last_year").alias("releases"), "readme", "watchers")


RULES = [("rings", 1, "phrase", "ring"), ("widgets", 2, "phrase", "widget"), ("bolts", 3, "phrase", "red bolt")]


# The entities after a day's discovery, refresh, countries and people; then the scores of the active ones.
_DAY = (
    with_views("metrics", "today", "entity", "link").rstrip().replace(" entity AS (", " entity0 AS (")
    + ", g AS (SELECT entity_id, COUNT(*) AS n, FLOOR(MAX(contributions) / SUM(contributions)::DOUBLE * 10000 + 0.5) / 10000 AS share FROM link WHERE entity_id % 10 = 0 GROUP BY entity_id), "
    "entity AS (SELECT e.* REPLACE (CASE WHEN e.id % 10 = 5 AND n.id IS NOT NULL THEN e.full_name || '#superseded-' || e.id WHEN e.id % 10 = 6 THEN p.full_name WHEN e.id % 10 = 4 THEN 'new/' || e.id ELSE e.full_name END AS full_name, "
    "CASE WHEN e.id % 10 = 5 AND n.id IS NOT NULL THEN 'rejected' ELSE e.status END AS status, CASE WHEN e.id % 2 = 0 THEN e.stars + 5 ELSE e.stars END AS stars, CASE WHEN e.id % 6 = 0 THEN 'changed' ELSE e.description END AS description, "
    "CASE WHEN e.id % 8 = 0 THEN 9 ELSE e.releases_last_year END AS releases_last_year, CASE WHEN e.id % 3 = 0 THEN 'NATION_5' ELSE e.owner_country END AS owner_country, "
    "CASE WHEN g.n IS NOT NULL THEN g.n ELSE e.contributors_count END AS contributors_count, CASE WHEN g.n IS NOT NULL THEN g.share ELSE e.top_contributor_share END AS top_contributor_share, "
    "CASE WHEN e.id % 6 = 0 AND e.description IS DISTINCT FROM 'changed' THEN NULL ELSE e.classified_on END AS classified_on) "
    "FROM entity0 e LEFT JOIN entity0 p ON p.id = e.id - 1 LEFT JOIN entity0 n ON n.id = e.id + 1 LEFT JOIN g ON g.entity_id = e.id), "
    + growth._ASOF + growth._GROWTH + growth._TREND + growth._QUALITY
    + ", day AS (SELECT s.*, now, status = 'active' AND id % 7 <> 0 AND (classified_on IS NULL OR synced_on IS NULL OR classified_on <= synced_on) AS due FROM scored s) "
)


def _day(spark, sf_dir, more: dict | None = None) -> tuple[Tables, refresh.Day]:
    """Versioned tables before a day, and the day: names that move, repeated rows, rows without an id, people, profiles, a new place for every third."""
    now = now_of(spark, sf_dir)
    null = lambda kind: F.lit(None).cast(kind)
    e = spark_view(spark, sf_dir, "entity").withColumns({
        "owner_location": F.when(F.col("id") % 3 == 0, "Nation 5"), "topics": F.array().cast("array<string>"), "readme": null("string"), "stars_day": null("long"), "stars_week": null("long"), "stars_month": null("long"),
        "trend_score": null("double"), "trend_velocity": null("double"), "quality_score": null("int"), "quality_grade": null("string"), "quality_flags": null("array<string>"),
    }).withColumn("contributors_count", F.col("contributors_count").cast("long")).withColumns(more or {})
    e = materialize(e, "entities")  # the day's tables and all that was fetched are read from it
    p, found = _people(spark, sf_dir)
    p = p.withColumns({"country": null("string"), "city": null("string"), "followers": null("long"), "synced_on": null("date")})
    alias, nowhere = _aliases(spark, sf_dir)
    by_hand = e.where("id % 7 = 0").select(F.col("id").alias("entity_id"), F.lit("by hand").alias("slug"), F.lit(True).alias("is_primary"), F.lit(1.0).alias("confidence"), F.array().cast("array<string>").alias("evidence"), F.lit("manual").alias("source"))
    metrics = spark_view(spark, sf_dir, "metrics").withColumn("month", F.date_format("recorded_on", "yyyy-MM"))
    tables = Tables(spark, scratch_path(spark, "tables"))
    tables.create({
        "entity": (e, ["id"], 4, None), "metrics": (metrics, ["id", "recorded_on"], 1, "month"), "person": (p, ["id"], 2, None),
        "link": (people.ranked(spark_view(spark, sf_dir, "link")).limit(0), ["entity_id", "person_id"], 2, None), "assignment": (by_hand, ["entity_id", "slug"], 2, None),
    })
    other = e.select((F.col("id") + 1).alias("id"), F.col("full_name").alias("__before"))
    name = F.when(F.col("id") % 10 == 6, F.coalesce("__before", "full_name")).when(F.col("id") % 10 == 4, F.concat(F.lit("new/"), F.col("id").cast("string"))).otherwise(F.col("full_name"))
    seen = e.where("id % 2 = 0").join(other, "id", "left")
    seen = seen.select("github_id", name.alias("full_name"), F.when(F.col("id") % 6 == 0, "changed").otherwise(F.col("description")).alias("description"), (F.col("stars") + 5).alias("stars"))
    nobody = seen.limit(5).withColumn("github_id", F.lit(0).cast("long")).unionByName(seen.limit(5).withColumn("github_id", null("long")))
    profiles = p.where("id % 3 = 0").select("login", F.lit("Town, Nation 3").alias("location"), F.col("id").alias("followers"))
    fetched = {
        "discovered": seen.unionByName(seen.withColumn("stars", F.col("stars") - 2)).unionByName(nobody), "refreshed": e.where("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, 9).alias("releases_last_year")),
        "people": found.where("entity_id % 10 = 0"), "profiles": profiles.unionByName(profiles.withColumn("followers", F.col("followers") - 1)),
    }
    rules = spark.createDataFrame(RULES, "category string, ordinal int, kind string, term string")
    return tables, refresh.Day(tables, fetched, rules, alias, nowhere, now, "one day")


@query(
    _DAY + "SELECT id, full_name, status, stars, stars_day, stars_week, contributors_count::BIGINT AS contributors_count, owner_country, CASE WHEN due THEN now ELSE classified_on END::VARCHAR AS classified_on, "
    "CASE WHEN status = 'active' THEN trend_score END AS trend_score, CASE WHEN status = 'active' THEN trend_velocity END AS trend_velocity, CASE WHEN status = 'active' THEN quality_score END AS quality_score, "
    f"CASE WHEN status = 'active' THEN quality_grade END AS quality_grade, CASE WHEN status = 'active' THEN {growth.FLAGS_SQL} END AS flags, "
    "CASE WHEN id % 7 = 0 THEN 'by hand' WHEN NOT due THEN NULL WHEN name LIKE '%ring%' THEN 'rings' WHEN name LIKE '%widget%' THEN 'widgets' WHEN name = 'red bolt' THEN 'bolts' END AS category FROM day"
)
def daily_run(spark, sf_dir):
    """One day of all stages over versioned tables, cut behind the snapshot and taken up again."""
    tables, day = _day(spark, sf_dir)
    day.run(refresh.STAGES[:3])
    day.run()
    primary = tables.read("assignment").where("is_primary").select(F.col("entity_id").alias("id"), F.col("slug").alias("category"))
    out = tables.read("entity").join(primary, "id", "left").withColumns({"flags": F.array_join("quality_flags", "; "), "classified_on": F.col("classified_on").cast("string")})
    return out.select("id", "full_name", "status", "stars", "stars_day", "stars_week", "contributors_count", "owner_country", "classified_on", "trend_score", "trend_velocity", "quality_score", "quality_grade", "flags", "category")


_ADDED = (
    with_views("metrics", "today", "entity").rstrip().replace(" entity AS (", " entity0 AS (")
    + ", entity AS (SELECT e.* REPLACE (CASE WHEN id % 2 = 0 THEN stars + 5 ELSE stars END AS stars, CASE WHEN id % 6 = 0 THEN 'added' ELSE description END AS description, "
    "CASE WHEN id % 6 = 0 AND description IS DISTINCT FROM 'added' THEN NULL ELSE classified_on END AS classified_on) FROM entity0 e "
    "UNION ALL SELECT e.* REPLACE (top + 5000000 + id + 1 AS id, 5000000 + id AS github_id, 'new/' || id AS full_name, 'active' AS status, NULL AS synced_on, NULL AS classified_on) FROM entity0 e, (SELECT MAX(id) AS top FROM entity0) WHERE id % 50 = 1), "
    + growth._ASOF + growth._GROWTH + growth._TREND + growth._QUALITY
    + ", day AS (SELECT s.*, status = 'active' AND NOT (id % 7 = 0 AND id < 5000000) AND (classified_on IS NULL OR synced_on IS NULL OR classified_on <= synced_on) AS due FROM scored s) "
)


@query(
    _ADDED + "SELECT id, full_name, status, stars, synced_on::VARCHAR AS synced_on, CASE WHEN status = 'active' THEN trend_score END AS trend_score, CASE WHEN status = 'active' THEN quality_score END AS quality_score, "
    "CASE WHEN id < 5000000 AND id % 7 = 0 THEN 'by hand' WHEN NOT due THEN NULL WHEN name LIKE '%ring%' THEN 'rings' WHEN name LIKE '%widget%' THEN 'widgets' WHEN name = 'red bolt' THEN 'bolts' END AS category, "
    "CASE WHEN id > 5000000 THEN 'manual:add' WHEN id % 4 = 0 THEN 'topic:x' END AS discovery_source FROM day"
)
def added_entities(spark, sf_dir):
    """Half of the entities named in other letters and forms, some that are new, some that are not found and some faulty; then classified and scored."""
    tables, day = _day(spark, sf_dir, {"discovery_source": F.when(F.col("id") % 4 == 0, "topic:x")})
    e, k = tables.read("entity"), F.col("id").cast("string")
    new = e.where("id % 50 = 1").withColumns({"github_id": F.col("id") + 5_000_000, "full_name": F.concat(F.lit("new/"), k), "status": F.lit("active")})
    old = e.where("id % 2 = 0").withColumns({"stars": F.col("stars") + 5, "description": F.when(F.col("id") % 6 == 0, "added").otherwise(F.col("description"))})
    raw = e.where("id % 2 = 0").select(F.concat(F.lit("https://github.com/"), F.upper("full_name")).alias("raw"))
    for form in (F.concat(F.lit("git@github.com:new/"), k), F.concat(F.lit("none/"), k), F.lit("no such")):
        raw = raw.unionByName(e.where("id % 50 = 1").select(form.alias("raw")))
    found, left = refresh.intake(raw, new.unionByName(old).drop("id", "stars_day", "stars_week", "stars_month", *scores.SCORES))
    if left.groupBy("error").count().count() < 2:  # one reason for names that none has, one for what is no reference
        raise ValueError("references that bring nothing are not told apart")
    day.found = {"discovered": found}
    day.run(refresh.INTAKE)
    primary = tables.read("assignment").where("is_primary").select(F.col("entity_id").alias("id"), F.col("slug").alias("category"))
    out = tables.read("entity").join(primary, "id", "left").withColumn("synced_on", F.col("synced_on").cast("string"))
    return out.select("id", "full_name", "status", "stars", "synced_on", "trend_score", "quality_score", "category", "discovery_source")


@query(
    with_views("person", "link").rstrip() + ", f AS (SELECT DISTINCT person_id + 1050 AS github_id, 's' || person_id AS login, CASE WHEN person_id % 2 = 0 THEN 'new.png' END AS avatar_url FROM link WHERE entity_id % 10 = 0), top AS (SELECT MAX(id) AS top FROM person), "
    "a AS (SELECT p.id, COALESCE(f.login, p.login) AS login, COALESCE(f.avatar_url, 'old.png') AS avatar_url, p.login AS was FROM person p LEFT JOIN f ON f.github_id = p.id + 1000 UNION ALL SELECT top + github_id + 1, login, avatar_url, NULL FROM f, top WHERE github_id NOT IN (SELECT id + 1000 FROM person)) "
    "SELECT a.id, a.login, avatar_url, CASE WHEN q.id IS NOT NULL THEN 'NATION_3' END AS country, CASE WHEN q.id IS NOT NULL THEN 'Town' END AS city, q.id AS followers FROM a LEFT JOIN (SELECT id, s_name FROM person JOIN supplier ON s_suppkey = id WHERE id % 3 = 0) q ON q.s_name = a.login"
)
def daily_people(spark, sf_dir):
    """The people after the same day: new ones, new logins, avatars and profiles of the logins that stayed."""
    tables, day = _day(spark, sf_dir)
    day.run(("contributors", "profiles"))
    return tables.read("person").select("id", "login", "avatar_url", "country", "city", "followers")
