"""Queries on listings, statistics, people and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendlake.operators import aggregates, listing, merge, people, search, shards
from trendlake.functions.scoring import licence_class
from trendlake.plans.growth import SCORED_SQL, now_of, stored_scores
from trendlake.plans.registry import query
from trendlake.plans.views import TABLES, spark_view, table, with_views
from trendlake.sources import exports
from trendlake.storage import scratch_path
from trendlake.versions import Tables

_L = "EXISTS (SELECT 1 FROM assignment a JOIN category c USING (slug) WHERE a.entity_id = s.id AND a.is_primary AND c.group_slug = 'group-S')"
ALL_SQL = SCORED_SQL.rstrip() + ", " + with_views("category", "assignment", "person", "link").removeprefix("WITH ")
_V = "s.id, s.stars"


def _views(spark, sf_dir, *names):
    return [spark_view(spark, sf_dir, n) for n in names]


def _list(spark, sf_dir, **params):
    return listing.list_entities(stored_scores(spark, sf_dir), listing.Listing(**params), *_views(spark, sf_dir, "assignment", "category"))


for _sort, _cols in listing.SORTS.items():
    if _sort != "relevance":
        query(
            ALL_SQL + f"SELECT s.id, {_cols[0]}{'::VARCHAR' if _cols[0].endswith('_on') else ''} AS value, COUNT(*) OVER () AS total FROM scored s WHERE status = 'active' AND NOT is_archived ORDER BY {_cols[0]} DESC NULLS LAST, s.id DESC LIMIT 24",
            name=f"list_by_{_sort.replace('-', '_')}",
        )(
            lambda spark, sf_dir, s=_sort, c=_cols[0]: _list(spark, sf_dir, sort=s).select(
                "id", (F.col(c).cast("string") if c.endswith("_on") else F.col(c)).alias("value"), "total"
            )
        )


@query(ALL_SQL + f"SELECT s.id, stars, license_class, COUNT(*) OVER () AS total FROM scored s WHERE status = 'active' AND stars BETWEEN 100 AND 100000 AND quality_score >= 20 AND {_L} AND created_on >= DATE '1990-01-01' AND pushed_on >= DATE '1995-01-01' ORDER BY stars DESC, s.id DESC LIMIT 10 OFFSET 10")
def list_filtered(spark, sf_dir):
    df = _list(spark, sf_dir, sort="stars", group="group-S", min_stars=100, max_stars=100000, min_quality=20, created_after="1990-01-01", pushed_after="1995-01-01", include_archived=True, page=2, per_page=10)
    return df.select("id", "stars", "license_class", "total")


@query(ALL_SQL + "SELECT s.id, license_class, owner_country FROM scored s WHERE status = 'active' AND NOT is_archived AND license_class = 'none' AND owner_country = 'NATION_7' ORDER BY trend_score DESC NULLS LAST, s.id DESC LIMIT 100")
def list_by_licence_and_country(spark, sf_dir):
    return _list(spark, sf_dir, license="none", country="NATION_7", per_page=500).select("id", "license_class", "owner_country")


@query(ALL_SQL + "SELECT s.id, language FROM scored s WHERE status = 'active' AND language = 'Brand#7' ORDER BY trend_score DESC NULLS LAST, s.id DESC LIMIT 24")
def list_by_language(spark, sf_dir):
    return _list(spark, sf_dir, language="Brand#7", include_archived=True, sort="relevance").select("id", "language")


@query(ALL_SQL + "SELECT s.id, (SELECT string_agg(slug, ',' ORDER BY is_primary DESC, confidence DESC, slug) FROM assignment a JOIN category c USING (slug) WHERE a.entity_id = s.id) AS categories FROM scored s WHERE status = 'active' AND NOT is_archived ORDER BY stars DESC, s.id DESC LIMIT 24")
def list_chips(spark, sf_dir):
    return _list(spark, sf_dir, sort="stars").select("id", F.array_join("categories", ",").alias("categories"))


_TOKENS = "toks AS (SELECT id, token, MAX(w) AS w FROM (SELECT id, UNNEST(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+')) AS token, 1.0::DOUBLE AS w FROM scored UNION ALL SELECT id, UNNEST(regexp_split_to_array(lower(description), '[^\\p{L}\\p{N}]+')), 0.4::DOUBLE FROM scored WHERE description IS NOT NULL) t GROUP BY id, token), "


@query(SCORED_SQL.rstrip() + ", " + _TOKENS + "rk AS (SELECT id, SUM(w) AS r FROM toks WHERE token = 'widget' GROUP BY id) SELECT s.id, ROUND((COALESCE(r, 0) + CASE WHEN full_name ILIKE 'widget%' THEN 1.0 WHEN name ILIKE 'widget%' THEN 0.8 WHEN full_name ILIKE '%widget%' THEN 0.4 ELSE 0 END) * 1000) AS relevance FROM scored s LEFT JOIN rk USING (id) WHERE status = 'active' AND NOT is_archived AND (r IS NOT NULL OR full_name ILIKE '%widget%' OR description ILIKE '%widget%') ORDER BY 2 DESC, 1 DESC LIMIT 50")
def search_relevance(spark, sf_dir):
    return _list(spark, sf_dir, q="Widget", sort="relevance", per_page=50).select("id", F.round(F.col("relevance") * 1000).alias("relevance"))


def _postings(spark, sf_dir) -> Tables:
    e = spark_view(spark, sf_dir, "entity").select("id", "name", "description")
    tables = Tables(spark, scratch_path(spark, "postings"))
    tables.create({"posting": (search.postings(e), search.KEYS, 16, None)})
    return tables


_WORDS = "w AS (SELECT id, ' ' || lower(name) || ' ' AS name, ' ' || lower(COALESCE(description, '')) || ' ' AS d FROM entity), "


def _weight(word: str) -> str:
    return f"CASE WHEN name LIKE '% {word} %' THEN 1.0 WHEN d LIKE '% {word} %' THEN 0.4 ELSE 0 END::DOUBLE"


@query(
    with_views("entity").rstrip() + ", " + _WORDS + f"h AS (SELECT id, {_weight('red')} + {_weight('bolt')} + {_weight('widget')} AS text_rank FROM w "
    "WHERE (name LIKE '% red bolt %' AND NOT (d LIKE '% steel %' OR name LIKE '% steel %')) OR name LIKE '% widget %' OR d LIKE '% widget %') SELECT id, ROUND(text_rank * 10) AS text_rank FROM h"
)
def search_syntax(spark, sf_dir):
    """A phrase, an excluded word and an alternative in another form of its word, over stored postings."""
    return search.search(_postings(spark, sf_dir), '"Red bolts" -steel or widgets').select("id", F.round(F.col("text_rank") * 10).alias("text_rank"))


@query(with_views("entity").rstrip() + ", " + _WORDS + "n AS (SELECT id, CASE WHEN id % 5 = 0 THEN ' green lamp ' ELSE name END AS name, d FROM w) SELECT id, CASE WHEN name LIKE '% lamp %' THEN 10 ELSE 4 END::DOUBLE AS text_rank FROM n WHERE name LIKE '% lamp %' OR d LIKE '% lamp %'")
def search_after_edits(spark, sf_dir):
    """Postings in step with entities that got another name."""
    tables, e = _postings(spark, sf_dir), spark_view(spark, sf_dir, "entity").select("id", "name", "description").where("id % 5 = 0")
    search.refresh(tables, "edits", e, e.withColumn("name", F.lit("green lamps")))
    return search.search(tables, "lamp").select("id", F.round(F.col("text_rank") * 10).alias("text_rank"))


@query("SELECT n_nationkey AS id FROM nation WHERE n_name ILIKE '%n\\_1%' ESCAPE '\\' OR n_name ILIKE '%n\\%2%' ESCAPE '\\'")
def substring_match(spark, sf_dir):
    """Signs of patterns in a query stand for themselves."""
    df = table(spark, sf_dir, "nation")
    return df.where(listing.contains(F.col("n_name"), "n_1") | listing.contains(F.col("n_name"), "n%2") | listing.contains(F.col("n_name"), "n-3")).select(F.col("n_nationkey").alias("id"))


@query(with_views("entity") + "SELECT id, full_name FROM entity WHERE id = (SELECT MIN(id) FROM entity)")
def entity_by_name(spark, sf_dir):
    df = spark_view(spark, sf_dir, "entity")
    name = df.orderBy("id").limit(1).first()["full_name"]
    return listing.by_name(df, f" {name.upper()}/ ").select("id", "full_name")


@query(ALL_SQL + "SELECT s.id, stars, stars_week FROM scored s WHERE status = 'active' AND NOT is_archived ORDER BY stars_week DESC NULLS LAST, s.id DESC LIMIT 8")
def trending_week(spark, sf_dir):
    return listing.trending(stored_scores(spark, sf_dir), "week", 8, *_views(spark, sf_dir, "assignment", "category")).select("id", "stars", "stars_week")


@query(with_views("entity") + "SELECT id FROM entity ORDER BY synced_on NULLS FIRST, id LIMIT 100")
def sync_queue(spark, sf_dir):
    return listing.work_queue(spark_view(spark, sf_dir, "entity"), "synced_on", 100).select("id")


@query(with_views("entity") + "SELECT id FROM entity WHERE classified_on IS NULL OR synced_on IS NULL OR classified_on <= synced_on")
def classify_candidates(spark, sf_dir):
    return spark_view(spark, sf_dir, "entity").where("classified_on is null or synced_on is null or classified_on <= synced_on").select("id")


@query(with_views("entity", "today") + "SELECT id FROM entity, today WHERE contributors_count IS NULL OR synced_on IS NULL OR synced_on < now - 7")
def stale_entities(spark, sf_dir):
    now = now_of(spark, sf_dir)
    return spark_view(spark, sf_dir, "entity").where(F.col("contributors_count").isNull() | F.col("synced_on").isNull() | (F.col("synced_on") < F.date_sub(now, 7))).select("id")


@query(with_views("entity") + "SELECT DISTINCT license_spdx_id FROM entity WHERE status = 'active'")
def distinct_licences(spark, sf_dir):
    return spark_view(spark, sf_dir, "entity").where("status = 'active'").select("license_spdx_id").distinct()


@query(ALL_SQL + "SELECT c.slug, c.group_slug, COUNT(x.id) AS n, COALESCE(SUM(x.stars), 0)::BIGINT AS stars, COALESCE(SUM(x.stars_week), 0)::BIGINT AS week, quantile_cont(x.quality_score, 0.5) AS median_quality FROM category c LEFT JOIN (SELECT a.slug, s.* FROM assignment a JOIN scored s ON s.id = a.entity_id WHERE a.is_primary AND s.status = 'active') x ON x.slug = c.slug GROUP BY c.slug, c.group_slug")
def category_stats(spark, sf_dir):
    df = aggregates.category_stats(stored_scores(spark, sf_dir), *_views(spark, sf_dir, "assignment", "category"))
    return df.drop("sort_order", "median_grade")


@query(ALL_SQL + "SELECT c.group_slug, COUNT(DISTINCT c.slug) AS categories, COUNT(x.id) AS n, COALESCE(SUM(x.stars), 0)::BIGINT AS stars, COALESCE(SUM(x.stars_week), 0)::BIGINT AS week FROM category c LEFT JOIN (SELECT a.slug, s.* FROM assignment a JOIN scored s ON s.id = a.entity_id WHERE a.is_primary AND s.status = 'active') x ON x.slug = c.slug GROUP BY c.group_slug")
def category_groups(spark, sf_dir):
    return aggregates.group_stats(aggregates.category_stats(stored_scores(spark, sf_dir), *_views(spark, sf_dir, "assignment", "category")))


_GROUPS = "(VALUES ('group-S', 0), ('group-none', 1), ('group-E', 2)) t(group_slug, place)"


def _groups(spark):
    """Three groups of the taxonomy, one without categories; all others are unknown to it."""
    return spark.createDataFrame([("group-S", 0), ("group-none", 1), ("group-E", 2)], "group_slug string, place int")


@query(ALL_SQL + f"SELECT group_slug, row_number() OVER (ORDER BY t.place NULLS LAST, sort_order, group_slug) AS place, COALESCE(categories, 0) AS categories, COALESCE(n, 0) AS n FROM (SELECT c.group_slug, MIN(c.sort_order) AS sort_order, COUNT(DISTINCT c.slug) AS categories, COUNT(x.id) AS n FROM category c LEFT JOIN (SELECT a.slug, s.id FROM assignment a JOIN scored s ON s.id = a.entity_id WHERE a.is_primary AND s.status = 'active') x ON x.slug = c.slug GROUP BY c.group_slug) g FULL JOIN {_GROUPS} USING (group_slug)")
def ordered_groups(spark, sf_dir):
    stats = aggregates.category_stats(stored_scores(spark, sf_dir), *_views(spark, sf_dir, "assignment", "category"))
    return aggregates.ordered_groups(stats, _groups(spark)).select("group_slug", "place", "categories", "n")


_FIRST = [("trending-day", "stars_day", ""), ("trending-week", "stars_week", ""), ("newest", "created_on", ""), ("quality", "quality_score", "AND quality_score >= 60")]


@query(
    ALL_SQL.rstrip() + ", totals AS (SELECT COUNT(*) AS entities, SUM(stars)::BIGINT AS stars, SUM(stars_week)::BIGINT AS stars_week, COUNT(*) FILTER (first_seen_on >= now - 1000) AS new_entities, COUNT(DISTINCT language) AS languages, COUNT(DISTINCT owner_country) AS countries, (SELECT COUNT(*) FROM person) AS people, (SELECT COUNT(*) FROM category) AS categories FROM scored WHERE status = 'active'), "
    "per AS (SELECT c.group_slug, MIN(c.sort_order) AS sort_order, COUNT(x.id) AS n FROM category c LEFT JOIN (SELECT a.slug, s.id FROM assignment a JOIN scored s ON s.id = a.entity_id WHERE a.is_primary AND s.status = 'active') x ON x.slug = c.slug GROUP BY c.group_slug) "
    "SELECT 'total' AS section, name, 0 AS place, value::BIGINT AS value FROM (UNPIVOT totals ON COLUMNS(*) INTO NAME name VALUE value) "
    + "".join(f"UNION ALL SELECT 'list', '{n}', row_number() OVER (ORDER BY {c} DESC NULLS LAST, id DESC) AS nth, id FROM scored WHERE status = 'active' AND NOT is_archived {more} QUALIFY nth <= 8 " for n, c, more in _FIRST)
    + f"UNION ALL SELECT 'group', group_slug, row_number() OVER (ORDER BY t.place NULLS LAST, sort_order, group_slug), COALESCE(n, 0) FROM per FULL JOIN {_GROUPS} USING (group_slug)"
)
def home_page(spark, sf_dir):
    people_, category, assignment = _views(spark, sf_dir, "person", "category", "assignment")
    return listing.home_page(stored_scores(spark, sf_dir), people_, category, assignment, _groups(spark), F.date_sub(now_of(spark, sf_dir), 1000))


@query(ALL_SQL + "SELECT c.slug, CASE WHEN m IS NULL THEN NULL WHEN m >= 80 THEN 'A' WHEN m >= 65 THEN 'B' WHEN m >= 50 THEN 'C' WHEN m >= 35 THEN 'D' ELSE 'F' END AS median_grade FROM category c LEFT JOIN (SELECT a.slug, quantile_cont(quality_score, 0.5) AS m FROM assignment a JOIN scored s ON s.id = a.entity_id WHERE a.is_primary AND s.status = 'active' GROUP BY a.slug) x USING (slug)")
def category_grades(spark, sf_dir):
    return aggregates.category_stats(stored_scores(spark, sf_dir), *_views(spark, sf_dir, "assignment", "category")).select("slug", "median_grade")


@query(with_views("entity", "person") + "SELECT country, COALESCE(entities, 0) AS entities, COALESCE(stars, 0)::BIGINT AS stars, COALESCE(people, 0) AS people FROM (SELECT owner_country AS country, COUNT(*) AS entities, SUM(stars) AS stars FROM entity WHERE status = 'active' AND owner_country IS NOT NULL GROUP BY 1) e FULL JOIN (SELECT country, COUNT(*) AS people FROM person WHERE country IS NOT NULL GROUP BY 1) p USING (country)")
def country_stats(spark, sf_dir):
    return aggregates.country_stats(*_views(spark, sf_dir, "entity", "person"))


@query(with_views("entity") + "SELECT language, COUNT(*) AS n, SUM(stars)::BIGINT AS stars FROM entity WHERE status = 'active' AND language IS NOT NULL GROUP BY language")
def language_stats(spark, sf_dir):
    return aggregates.language_stats(spark_view(spark, sf_dir, "entity"))


@query(ALL_SQL + "SELECT COUNT(*) AS entities, SUM(stars)::BIGINT AS stars, SUM(stars_week)::BIGINT AS stars_week, COUNT(*) FILTER (first_seen_on >= now - 1000) AS new_entities, COUNT(DISTINCT language) AS languages, COUNT(DISTINCT owner_country) AS countries, (SELECT COUNT(*) FROM person) AS people, (SELECT COUNT(*) FROM category) AS categories FROM scored WHERE status = 'active'")
def global_stats(spark, sf_dir):
    return aggregates.global_stats(stored_scores(spark, sf_dir), *_views(spark, sf_dir, "person", "category"), F.date_sub(now_of(spark, sf_dir), 1000))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, COUNT(*) AS n FROM {t}" for t in TABLES) + " UNION ALL SELECT 'total', " + " + ".join(f"(SELECT COUNT(*) FROM {t})" for t in TABLES))
def row_counts(spark, sf_dir):
    return aggregates.row_counts({t: table(spark, sf_dir, t) for t in TABLES})


@query("SELECT o_orderkey AS id, o_orderpriority AS job, CAST(o_orderdate AS VARCHAR) AS finished_at FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def latest_ok_run(spark, sf_dir):
    runs = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("job"), F.struct("o_orderdate", "o_orderkey").alias("finished_at"), F.when(F.col("o_orderstatus") == "F", "ok").alias("status")
    )
    return aggregates.latest_ok_run(runs).select("id", "job", F.col("finished_at.o_orderdate").cast("string").alias("finished_at"))


@query(with_views("entity", "person", "link") + "SELECT p.id, p.login, COUNT(DISTINCT l.entity_id) AS entities, SUM(l.contributions)::BIGINT AS contributions, SUM(e.stars)::BIGINT AS stars_reached FROM person p JOIN link l ON l.person_id = p.id JOIN entity e ON e.id = l.entity_id WHERE e.status = 'active' GROUP BY p.id, p.login, p.followers ORDER BY entities DESC, contributions DESC, p.followers DESC, p.id LIMIT 50")
def top_people(spark, sf_dir):
    df = people.ranking(*_views(spark, sf_dir, "person", "link", "entity"))
    return df.orderBy(*people.order()).limit(50).select("id", "login", "entities", "contributions", "stars_reached")


@query(
    with_views("entity", "person", "link", "category", "assignment").rstrip() + ", k AS (SELECT l.* FROM link l JOIN entity e ON e.id = l.entity_id WHERE e.status = 'active' AND EXISTS (SELECT 1 FROM assignment a JOIN category c USING (slug) WHERE a.entity_id = e.id AND a.is_primary AND c.group_slug = 'group-S')), "
    "r AS (SELECT p.id, p.login, p.country, COUNT(DISTINCT k.entity_id) AS entities, SUM(k.contributions)::BIGINT AS contributions, SUM(e.stars)::BIGINT AS stars_reached, p.followers FROM person p JOIN k ON k.person_id = p.id JOIN entity e ON e.id = k.entity_id WHERE p.country IS NOT NULL GROUP BY ALL) "
    "SELECT id, login, country, entities, contributions, (SELECT COUNT(*) FROM r) AS total FROM r ORDER BY entities DESC, contributions DESC, followers DESC, id LIMIT 20 OFFSET 20"
)
def people_page(spark, sf_dir):
    """The second page of people with a country over one group of categories, with the number of all of them."""
    e, a, c, p, k = _views(spark, sf_dir, "entity", "assignment", "category", "person", "link")
    return people.page(p.where("country is not null"), k, listing.in_category(e, a, c, group="group-S"), 2, 20).select("id", "login", "country", "entities", "contributions", "total")


@query(ALL_SQL + "SELECT p.country, COUNT(DISTINCT p.id) AS people, SUM(l.contributions)::BIGINT AS contributions FROM person p JOIN link l ON l.person_id = p.id JOIN scored s ON s.id = l.entity_id WHERE s.status = 'active' AND EXISTS (SELECT 1 FROM assignment a JOIN category c USING (slug) WHERE a.entity_id = s.id AND a.is_primary AND c.group_slug = 'group-S') AND p.country IS NOT NULL GROUP BY p.country")
def people_of_group(spark, sf_dir):
    e, a, c, p, k = _views(spark, sf_dir, "entity", "assignment", "category", "person", "link")
    df = people.ranking(p.where("country is not null"), k, listing.in_category(e, a, c, group="group-S"))
    return df.groupBy("country").agg(F.count("*").alias("people"), F.sum("contributions").alias("contributions"))


@query(with_views("link") + "SELECT entity_id, contributors_count, FLOOR(m / s::DOUBLE * 10000 + 0.5) / 10000 AS top_contributor_share FROM (SELECT entity_id, COUNT(*) AS contributors_count, MAX(contributions) AS m, SUM(contributions) AS s FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY contributions DESC, person_id) AS rn FROM link) t WHERE rn <= 100 GROUP BY entity_id) g")
def concentration(spark, sf_dir):
    return people.concentration(spark_view(spark, sf_dir, "link"))


@query(with_views("link") + "SELECT entity_id, person_id, rn AS rank, FLOOR(contributions / SUM(contributions) OVER (PARTITION BY entity_id)::DOUBLE * 10000 + 0.5) / 10000 AS share FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY contributions DESC, person_id) AS rn FROM link) t WHERE rn <= 20")
def shown_people(spark, sf_dir):
    return people.shares(spark_view(spark, sf_dir, "link")).select("entity_id", "person_id", "rank", "share")


@query(with_views("person", "link") + "SELECT p.id, COUNT(*) AS links FROM person p JOIN link l ON l.person_id = p.id WHERE p.synced_on IS NULL GROUP BY p.id ORDER BY links DESC, p.id LIMIT 25")
def enrichment_queue(spark, sf_dir):
    return people.enrichment_queue(*_views(spark, sf_dir, "person", "link"), 25).select("id", "links")


@query(with_views("entity", "link") + "SELECT id FROM entity e WHERE stars >= 10 AND NOT EXISTS (SELECT 1 FROM link l WHERE l.entity_id = e.id AND l.person_id % 20 = 0) ORDER BY stars DESC, id LIMIT 100")
def backfill_queue(spark, sf_dir):
    e, k = _views(spark, sf_dir, "entity", "link")
    return people.backfill_queue(e, k.where("person_id % 20 = 0"), 10, 100).select("id")


@query("SELECT l_partkey AS entity_id, MIN(low) AS first_person, SUM(best)::BIGINT AS contributions FROM (SELECT l_partkey, l_suppkey % 40 + 1 AS low, MAX(q) AS best FROM (SELECT l_partkey, l_suppkey, SUM(l_quantity) AS q FROM lineitem GROUP BY 1, 2) x GROUP BY 1, 2) y GROUP BY l_partkey")
def folded_people(spark, sf_dir):
    k = spark_view(spark, sf_dir, "link")
    ids = k.select(F.col("person_id").alias("id")).unionByName(k.select((F.col("person_id") % 40 + 1).alias("id"))).distinct()
    folks = ids.select("id", (F.when(F.col("id") <= 40, F.col("id")).otherwise(F.col("id") % 40 + 1)).cast("string").alias("login"))
    links = k.withColumn("person_id", F.col("person_id") + 1000 * 40).withColumn("person_id", F.col("person_id") % 40 + 1)
    links = k.select("entity_id", (F.col("person_id") % 40 + 1 + F.when(F.col("person_id") % 2 == 0, 40000).otherwise(80000)).alias("person_id"), "contributions")
    low = links.select(F.col("person_id").alias("id")).distinct()
    folks = low.select("id", ((F.col("id") - 1) % 40 + 1).cast("string").alias("login")).unionByName(spark.range(1, 41).select("id", F.col("id").cast("string").alias("login")))
    kept, strongest = merge.fold_people(folks, links)
    strongest = strongest.join(kept.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    return strongest.groupBy("entity_id").agg(F.min("person_id").alias("first_person"), F.sum("contributions").alias("contributions"))


_NEW = "SELECT id, github_id, full_name, CASE WHEN id % 3 = 0 THEN 'changed' ELSE description END AS description, stars + 5 AS stars FROM entity WHERE id % 2 = 0"


@query(with_views("entity") + "SELECT id, CASE WHEN id % 2 = 0 THEN stars + 5 ELSE stars END AS stars, CASE WHEN id % 2 = 0 AND (CASE WHEN id % 3 = 0 THEN 'changed' ELSE description END) IS DISTINCT FROM description THEN NULL ELSE CAST(classified_on AS VARCHAR) END AS classified_on, FALSE AS is_new FROM entity UNION ALL SELECT id + 5000000, stars + 5, NULL, TRUE FROM entity WHERE id % 40 = 0")
def discovery_upsert(spark, sf_dir):
    old = spark_view(spark, sf_dir, "entity")
    desc = F.when(F.col("id") % 3 == 0, "changed").otherwise(F.col("description"))
    seen = old.where("id % 2 = 0").select("id", "github_id", "full_name", desc.alias("description"), (F.col("stars") + 5).alias("stars"))
    fresh = old.where("id % 40 = 0").select((F.col("id") + 5000000).alias("id"), (F.col("github_id") + 5000000).alias("github_id"), "full_name", "description", (F.col("stars") + 5).alias("stars"))
    same = F.col("n").isNull() | F.col("o.description").eqNullSafe(F.col("n.description"))
    out = merge.upsert(old, seen.unionByName(fresh), ["github_id"], {"id": "keep", "status": "keep"}, {"classified_on": F.when(same, F.col("o.classified_on"))})
    return out.select("id", "stars", F.col("classified_on").cast("string").alias("classified_on"), "is_new")


@query(with_views("entity") + "SELECT id, COALESCE(CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN 7 ELSE releases_last_year END, releases_last_year) AS releases_last_year, CASE WHEN id % 4 = 1 THEN stars + 1 ELSE stars END AS stars FROM entity")
def refresh_upsert(spark, sf_dir):
    old = spark_view(spark, sf_dir, "entity")
    new = old.where("id % 4 in (0, 1)").select(
        "id", F.when(F.col("id") % 4 == 1, 7).alias("releases_last_year"), (F.col("stars") + (F.col("id") % 4 == 1).cast("int")).alias("stars")
    )
    return merge.upsert(old, new, ["id"], {"releases_last_year": "fill"}).select("id", "releases_last_year", "stars")


@query(with_views("entity") + "SELECT id, CASE WHEN id % 10 = 3 THEN CONCAT(full_name, '#superseded-', CAST(id AS VARCHAR)) ELSE full_name END AS full_name, CASE WHEN id % 10 = 3 THEN 'rejected' ELSE status END AS status FROM entity")
def superseded_names(spark, sf_dir):
    old = spark_view(spark, sf_dir, "entity")
    incoming = old.where("id % 10 = 3").select((F.col("github_id") + 9).alias("github_id"), "full_name").unionByName(old.where("id % 10 = 4").select("github_id", "full_name"))
    return merge.release_names(old, incoming).select("id", "full_name", "status")


@query(with_views("assignment") + "SELECT entity_id, slug, source FROM assignment WHERE source = 'manual' OR entity_id % 2 = 1 UNION ALL SELECT a.entity_id, a.slug, 'rule' FROM assignment a WHERE a.entity_id % 2 = 0 AND a.is_primary AND a.source <> 'manual'")
def replace_assignments(spark, sf_dir):
    old = spark_view(spark, sf_dir, "assignment")
    new = old.where("entity_id % 2 = 0 and is_primary").withColumn("source", F.lit("rule"))
    return merge.replace_automatic(old, new, new).select("entity_id", "slug", "source")


@query("SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)) t WHERE rn = 1")
def absent_submissions(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    new = merge.keep_one(pages, ["url"], F.col("page_id"))
    return merge.insert_absent(pages.where("page_id % 2 = 0"), new, "url")[0]


@query(
    "SELECT url, error, outcome, COUNT(*) AS n FROM (SELECT CASE WHEN page_id % 5 < 3 THEN 'https://github.com/own/n' || page_id % 100 END AS url, CASE page_id % 5 WHEN 3 THEN 'host not supported' WHEN 4 THEN 'page inside a repository' END AS error, "
    "CASE WHEN page_id % 5 >= 3 THEN 'faulty' WHEN page_id % 100 < 50 AND page_id = MIN(page_id) OVER (PARTITION BY page_id % 100) THEN 'new' ELSE 'repeated' END AS outcome FROM pages) t GROUP BY ALL"
)
def submitted_references(spark, sf_dir):
    """Many pages name one repository in three forms; half of the repositories were submitted before."""
    slug = F.concat(F.lit("own/n"), (F.col("page_id") % 100).cast("string"))
    shape = [F.concat(F.lit(" https://www.GitHub.com/"), slug, F.lit(".git/?tab=x#y")), F.concat(F.lit("git@github.com:"), slug, F.lit(".git")), slug, F.lit("https://other.example/x"), F.concat(F.lit("github.com/own/name/tree/"), slug)]
    raw = table(spark, sf_dir, "pages").select(F.element_at(F.array(*shape), (F.col("page_id") % 5 + 1).cast("int")).alias("url"), F.col("page_id").cast("string").alias("note"))
    before = spark.range(50, 100).select(F.concat(F.lit("https://github.com/own/n"), F.col("id").cast("string")).alias("url"))
    return merge.submissions(before, raw).groupBy("url", "error", "outcome").agg(F.sum("n").alias("n"))


@query(with_views("entity", "category", "today") + "SELECT CONCAT('https://catalogue.example/repos/', owner_login, '/', REPLACE(name, ' ', '%20')) AS url, CAST(COALESCE(synced_on, pushed_on, now) AS VARCHAR) AS lastmod FROM (SELECT * FROM entity WHERE status = 'active' ORDER BY stars DESC, id DESC LIMIT 45000) e, today UNION ALL SELECT CONCAT('https://catalogue.example/categories/', REPLACE(slug, ' ', '%20')), CAST(now AS VARCHAR) FROM category, today UNION ALL SELECT CONCAT('https://catalogue.example', p), CAST(now AS VARCHAR) FROM (VALUES ('/'), ('/about')) v(p), today")
def address_export(spark, sf_dir):
    e, c = _views(spark, sf_dir, "entity", "category")
    return exports.addresses(e, c, "https://catalogue.example", now_of(spark, sf_dir), ["/", "/about"]).withColumn("lastmod", F.col("lastmod").cast("string"))


@query(with_views("entity") + "SELECT id, 'SoftwareSourceCode' AS type, name, description, language FROM entity")
def structured_export(spark, sf_dir):
    df = exports.structured(spark_view(spark, sf_dir, "entity"))
    j = F.from_json("body", "type string, name string, description string, programmingLanguage string")
    return df.select("id", j.alias("j")).select("id", "j.type", "j.name", "j.description", F.col("j.programmingLanguage").alias("language"))


@query("SELECT o_orderpriority AS topic, COUNT(*) AS n, TRUE AS split, TRUE AS capped, TRUE AS recounted FROM orders GROUP BY 1")
def shard_plan(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("topic"), F.floor("o_totalprice").alias("stars"), F.col("o_orderdate").cast("date").alias("day"))
    n = rows.count()
    cap = max(10, n // 40)
    out = shards.plan(rows, cap, 0, 10_000_000, "1970-01-01", "2100-01-01")
    r = rows.select(F.col("topic").alias("t"), "stars", "day")
    inside = (F.col("t") == F.col("topic")) & F.col("stars").between(F.col("stars_lo"), F.col("stars_hi")) & F.col("day").between(F.col("created_from"), F.col("created_to"))
    again = out.join(r, inside, "left").groupBy(*shards.KEYS, "total", "status", "shortfall").agg(F.count("stars").alias("own"))
    capped = (F.col("total") <= cap) | ((F.col("status") == "unsplittable") & (F.col("shortfall") == F.col("total") - cap))
    return again.groupBy("topic").agg(
        F.sum("own").alias("n"), (F.count("*") > 1).alias("split"), F.bool_and(capped).alias("capped"), F.bool_and(F.col("own") == F.col("total")).alias("recounted")
    )


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 9 = 0 THEN 'none' WHEN c_custkey % 9 = 1 THEN 'other' WHEN c_custkey % 9 = 2 THEN 'other' WHEN c_custkey % 9 = 3 THEN 'non-commercial' WHEN c_custkey % 9 IN (4, 5) THEN 'strong-copyleft' WHEN c_custkey % 9 = 6 THEN 'weak-copyleft' ELSE 'permissive' END AS class FROM customer")
def licence_classes(spark, sf_dir):
    ids = ["\t ", "NOASSERTION", "CC-BY-NC-4.0", "Foo-ND-2", "GPL-3.0-only", "AGPL-3.0", "LGPL-2.1", "0BSD", " MIT "]
    pick = F.element_at(F.array(*[F.lit(x) for x in ids]), (F.col("c_custkey") % 9 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), licence_class(pick).alias("class"))
