"""Queries on classification, locations, references and payloads."""

from __future__ import annotations

from pyspark.sql import functions as F

from trendlake.functions import text
from trendlake.operators import classify, listing, merge, people, places, temporal
from trendlake.plans.registry import query
from trendlake.plans.views import spark_view, table, with_views
from trendlake.sources import payloads

# Own small rules: words and phrases of the invented prose, and languages and sources as topics.
RULES = [
    ("prose", 1, "phrase", "of the"), ("prose", 1, "phrase", "in the"), ("prose", 1, "phrase", "that the"), ("prose", 1, "phrase", "the of"),
    ("prose", 1, "phrase", "to the"), ("german", 2, "topic", "de"), ("german", 2, "phrase", "der"), ("french", 3, "topic", "fr"), ("french", 3, "phrase", "de la"),
    ("legal", 4, "phrase", "licensed under"), ("legal", 4, "phrase", "mit license"), ("spanish", 5, "topic", "es"), ("hot", 6, "topic", "src0"), ("hot", 6, "topic", "src3"),
]
_VALUES = ", ".join(f"('{c}', {o}, '{k}', '{t}')" for c, o, k, t in RULES)
_FIELDS = "d AS (SELECT doc_id AS id, 'Doc-' || doc_id AS name, substring(text, 1, 200) AS description, substring(text, 1, 4000) AS readme, lower(lang) AS lang, lower(source) AS source FROM documents)"
_MATCH = "regexp_matches(lower({f}), '(^|[^a-z0-9])' || replace(term, ' ', '[\\s_-]+') || '($|[^a-z0-9])')"
SCORES_SQL = (
    f"WITH {_FIELDS}, r(category, ordinal, kind, term) AS (VALUES {_VALUES}), h AS (SELECT id, category, ordinal, "
    "SUM(CASE WHEN kind = 'topic' AND term IN (lang, source) THEN 1 ELSE 0 END) AS t, "
    + ", ".join(f"SUM(CASE WHEN kind = 'phrase' AND {_MATCH.format(f=f)} THEN 1 ELSE 0 END) AS {a}" for f, a in (("name", "n"), ("description", "d"), ("readme", "m")))
    + " FROM d, r GROUP BY id, category, ordinal), s AS (SELECT id, category, ordinal, CAST(10 * t + 6 * n + 3 * d + LEAST(m, 4) AS BIGINT) AS score FROM h WHERE 10 * t + 6 * n + 3 * d + LEAST(m, 4) > 0) "
)
DECIDED_SQL = SCORES_SQL.rstrip() + (
    ", o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ordinal) AS rn, MAX(score) OVER (PARTITION BY id) AS top FROM s), "
    "g AS (SELECT id, MAX(category) FILTER (rn = 1) AS primary_category, COALESCE(string_agg(category, ',' ORDER BY rn) FILTER (rn BETWEEN 2 AND 4 AND score >= GREATEST(6, top * 0.45)), '') AS secondary, "
    "MAX(top) AS top, COALESCE(MAX(score) FILTER (rn = 2), 0) AS second FROM o GROUP BY id), "
    "k AS (SELECT id, primary_category, secondary, FLOOR((0.5::DOUBLE * LEAST(1, top / 20.0::DOUBLE) + 0.5::DOUBLE * LEAST(1, (top - second) / 10.0::DOUBLE)) * 1000 + 0.5) / 1000 AS confidence FROM g) "
)


def rules(spark):
    return spark.createDataFrame(RULES, "category string, ordinal int, kind string, term string")


def texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("Doc-"), "doc_id").alias("name"), F.substring("text", 1, 200).alias("description"),
        F.col("text").alias("readme"), F.array("lang", "source").alias("topics"), F.col("lang").alias("language"),
    )


def decided(spark, sf_dir):
    return classify.decide(classify.scores(classify.hits(texts(spark, sf_dir), rules(spark))))


@query(SCORES_SQL + "SELECT id, category, score FROM s")
def category_scores(spark, sf_dir):
    return classify.scores(classify.hits(texts(spark, sf_dir), rules(spark))).select("id", "category", F.col("score").cast("long").alias("score"))


@query(DECIDED_SQL + "SELECT id, primary_category, secondary, confidence FROM k")
def category_decisions(spark, sf_dir):
    return decided(spark, sf_dir).select("id", "primary_category", F.array_join("secondary", ",").alias("secondary"), "confidence")


@query(DECIDED_SQL + "SELECT CASE WHEN k.id IS NULL THEN 'unclassified' WHEN confidence >= 0.5 THEN 'accept' ELSE 'escalate' END AS route, COUNT(*) AS n FROM documents LEFT JOIN k ON k.id = doc_id GROUP BY 1")
def classification_routes(spark, sf_dir):
    all_ = texts(spark, sf_dir).select("id")
    return classify.route(all_.join(decided(spark, sf_dir), "id", "left")).groupBy("route").agg(F.count("*").alias("n"))


MATCHED_SQL = (
    ", m AS (SELECT id, category, list_sort(list(DISTINCT x)) AS matched FROM (SELECT id, category, UNNEST([CASE WHEN kind = 'topic' AND term IN (lang, source) THEN 'topic:' || term END, "
    + ", ".join(f"CASE WHEN kind = 'phrase' AND {_MATCH.format(f=f)} THEN '{a}:' || term END" for f, a in (("name", "name"), ("description", "desc"), ("readme", "readme")))
    + "]) AS x FROM d, r) WHERE x IS NOT NULL GROUP BY id, category) "
)
_PLACED_SQL = (
    DECIDED_SQL.rstrip() + MATCHED_SQL + ", a AS (SELECT id, primary_category AS slug, TRUE AS is_primary, confidence, 8 AS most FROM k "
    "UNION ALL SELECT id, UNNEST(string_split(secondary, ',')), FALSE, FLOOR(confidence * 0.6::DOUBLE * 1000 + 0.5) / 1000, 6 FROM k WHERE secondary <> '') "
)


def fingerprinted(spark, sf_dir):
    d = texts(spark, sf_dir)
    return d.withColumn("fingerprint", text.fingerprint(*[F.col(c) for c in ("name", "description", "topics", "language", "readme")]))


@query(_PLACED_SQL + "SELECT a.id AS entity_id, slug, is_primary, confidence, TRUE AS cached, array_to_string(matched[1:most], ',') AS matched FROM a JOIN m ON m.id = a.id AND m.category = a.slug WHERE NOT (a.id % 5 = 0 AND slug = 'prose')")
def category_assignments(spark, sf_dir):
    """Every fifth entity is in prose by hand, which no rule overwrites."""
    d = fingerprinted(spark, sf_dir)
    by_hand = d.where("id % 5 = 0").select(F.col("id").alias("entity_id"), F.lit("prose").alias("slug"))
    rows = classify.expand(decided(spark, sf_dir), d, by_hand).join(d.select(F.col("id").alias("entity_id"), "fingerprint"), "entity_id")
    first = F.get("evidence", F.lit(0)) == F.col("fingerprint")
    return rows.select("entity_id", "slug", "is_primary", "confidence", first.alias("cached"), F.array_join(F.slice("evidence", 2, 99), ",").alias("matched"))


@query(DECIDED_SQL + "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT id FROM k) OR doc_id % 7 = 0")
def classification_settles(spark, sf_dir):
    """What a second run finds due after the first: entities without any category, and changed ones."""
    d = fingerprinted(spark, sf_dir)
    stored = classify.expand(decided(spark, sf_dir), d).withColumn("source", F.lit("rule"))
    changed = d.withColumn("fingerprint", F.when(F.col("id") % 7 == 0, "fp:changed").otherwise(F.col("fingerprint")))
    return classify.pending(changed, stored).select("id")


@query(
    DECIDED_SQL + "SELECT COUNT(*) AS considered, COUNT(*) FILTER (doc_id % 3 = 0) AS cached, COUNT(*) FILTER (doc_id % 3 <> 0 AND confidence >= 0.5) AS by_rule, "
    "COUNT(*) FILTER (doc_id % 3 <> 0 AND confidence < 0.5) AS escalated, COUNT(*) FILTER (doc_id % 3 <> 0 AND k.id IS NULL) AS unclassified, "
    "(COUNT(*) FILTER (doc_id % 3 <> 0 AND k.id IS NOT NULL) + SUM(CASE WHEN doc_id % 3 <> 0 AND secondary <> '' THEN length(secondary) - length(replace(secondary, ',', '')) + 1 ELSE 0 END))::BIGINT AS written, "
    "COUNT(*) FILTER (doc_id % 5 = 0) AS manual_preserved FROM documents LEFT JOIN k ON k.id = doc_id"
)
def classification_statistics(spark, sf_dir):
    """Every third entity is cached, every fifth has a category by hand."""
    d = fingerprinted(spark, sf_dir)
    due = d.where("id % 3 <> 0")
    routed = classify.route(decided(spark, sf_dir).join(due.select("id"), "id", "left_semi"))
    by_hand = d.where("id % 5 = 0").select(F.col("id").alias("entity_id"), F.lit("by hand").alias("slug"))
    return classify.statistics(d, due, routed, classify.expand(routed, d, by_hand), by_hand)


@query(with_views("entity", "today") + "SELECT id, CASE WHEN id % 4 = 0 THEN now ELSE classified_on END::VARCHAR AS classified_on FROM entity, today")
def classification_watermark(spark, sf_dir):
    e = spark_view(spark, sf_dir, "entity")
    now = spark_view(spark, sf_dir, "today")
    ids = e.where("id % 4 = 0").select("id")
    return classify.attempted(e.join(now), ids, F.col("now")).select("id", F.col("classified_on").cast("string").alias("classified_on"))


@query(with_views("entity", "assignment", "today") + "SELECT id, COALESCE(classified_on, last)::VARCHAR AS classified_on FROM entity LEFT JOIN (SELECT entity_id, MAX(now - (entity_id % 9 + CASE WHEN is_primary THEN 1 ELSE 0 END)::INT) AS last FROM assignment, today GROUP BY entity_id) ON entity_id = id")
def watermark_backfill(spark, sf_dir):
    a = spark_view(spark, sf_dir, "assignment").join(spark_view(spark, sf_dir, "today"))
    a = a.withColumn("assigned_on", F.expr("date_sub(now, cast(entity_id % 9 + if(is_primary, 1, 0) as int))"))
    return classify.filled_watermark(spark_view(spark, sf_dir, "entity"), a).select("id", F.col("classified_on").cast("string").alias("classified_on"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0")
def classification_cache(spark, sf_dir):
    """Every third entity has its fingerprint stored, every fifth only manual rows: the rest is due."""
    d = fingerprinted(spark, sf_dir)
    stored = d.select(F.col("id").alias("entity_id"), F.when(F.col("id") % 5 == 0, "manual").otherwise("rule").alias("source"), F.array(F.when(F.col("id") % 3 == 0, F.col("fingerprint")).otherwise("fp:old")).alias("evidence"))
    return classify.pending(d, stored).select("id")


@query("SELECT sha256(x) AS digest, COUNT(*) AS n FROM (SELECT 'fp:' || substring(sha1('{\"n\":\"Doc\",\"d\":\"' || source || '\",\"t\":[\"' || LEAST(lang, source) || '\",\"' || GREATEST(lang, source) || '\"],\"l\":\"' || lang || '\",\"r\":\"\"}'), 1, 16) AS x FROM documents) GROUP BY 1")
def fingerprints(spark, sf_dir):
    """Digests of short fields; the order of topics does not count."""
    d = table(spark, sf_dir, "documents")
    topics = F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array("source", "lang"))
    fp = text.fingerprint(F.lit("Doc"), F.col("source"), topics, F.col("lang"), F.lit(None).cast("string"))
    return d.groupBy(F.sha2(fp, 256).alias("digest")).agg(F.count("*").alias("n"))


@query("SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'good' END AS primary_category, CASE WHEN doc_id % 4 = 0 THEN 0.5 WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END::DOUBLE AS confidence FROM labels")
def external_labels(spark, sf_dir):
    c = F.when(F.col("doc_id") % 4 == 0, F.lit(float("nan"))).when(F.col("doc_id") % 4 == 1, 7.0).otherwise(-3.0)
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.lit("good").alias("category"), (F.col("quality") == 1).alias("related"), c.alias("confidence"), F.array().cast("array<string>").alias("secondary"))
    return classify.merge_external(rows).drop("secondary")


@query("SELECT category, fault FROM (VALUES ('twice', 'two ordinals'), ('empty', 'blank term')) v(category, fault) WHERE (SELECT COUNT(*) FROM part) > 0")
def rule_faults(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(F.lit("twice").alias("category"), (F.col("p_size") % 2).alias("ordinal"), F.lit("topic").alias("kind"), F.col("p_name").alias("term"))
    bad = spark.createDataFrame([("empty", 1, "topic", " ")], "category string, ordinal int, kind string, term string")
    return classify.rule_faults(rules(spark).unionByName(own).unionByName(bad))


@query(with_views("category").rstrip() + ", x AS (SELECT slug, CASE WHEN slug < 'M' THEN group_slug ELSE 'lost' END AS group_slug FROM category UNION ALL SELECT slug, 'group-S' FROM category WHERE slug = 'unused') "
    "SELECT DISTINCT p_name AS category, 'no such category' AS fault FROM part UNION ALL SELECT slug, 'no such group' FROM x WHERE group_slug = 'lost' UNION ALL SELECT 'unused', 'slug comes twice'")
def category_faults(spark, sf_dir):
    """Rules of categories that there are, and some of no category; categories whose group is gone; a slug that comes twice."""
    c = spark_view(spark, sf_dir, "category")
    moved = c.select("slug", F.when(F.col("slug") < "M", F.col("group_slug")).otherwise("lost").alias("group_slug"))
    moved = moved.unionByName(c.where("slug = 'unused'").select("slug", F.lit("group-S").alias("group_slug")))
    own = c.select(F.col("slug").alias("category"), F.col("sort_order").alias("ordinal"), F.lit("topic").alias("kind"), F.col("slug").alias("term"))
    strange = table(spark, sf_dir, "part").select(F.col("p_name").alias("category"), F.lit(1).alias("ordinal"), F.lit("topic").alias("kind"), F.lit("t").alias("term"))
    return classify.rule_faults(own.unionByName(strange), moved, c.select("group_slug").distinct())


@query("SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN n_name WHEN 1 THEN n_name WHEN 2 THEN n_name WHEN 3 THEN NULL WHEN 4 THEN n_name ELSE NULL END AS country, CASE s_suppkey % 6 WHEN 0 THEN 'Old Town' WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN 'Harbour' ELSE 'Nowhere Land' END AS city FROM supplier JOIN nation ON n_nationkey = s_nationkey")
def locations(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    n = F.initcap("n_name")
    shape = [F.concat(F.lit("(Old Town), "), n), n, F.concat(F.lit("Mars -> "), n), F.lit("  The Internet "), F.concat(F.lit("Harbour, ✨ Bay, "), F.upper(n)), F.lit("Nowhere Land")]
    raw = F.element_at(F.array(*shape), (F.col("s_suppkey") % 6 + 1).cast("int"))
    people = table(spark, sf_dir, "supplier").join(nation, F.col("n_nationkey") == F.col("s_nationkey")).select(F.col("s_suppkey").alias("id"), raw.alias("location"))
    aliases = nation.select(F.lower(F.translate("n_name", "_", " ")).alias("alias"), F.col("n_name").alias("country"))
    return places.resolve(people, aliases, spark.createDataFrame([("the internet",), ("remote",)], "value string"))


@query("SELECT page_id, page_id % 5 < 3 AS ok, CASE page_id % 5 WHEN 0 THEN 'own' || page_id || '/name.' || page_id WHEN 1 THEN 'own' || page_id || '/n' WHEN 2 THEN 'o/n' || page_id END AS full_name, CASE page_id % 5 WHEN 3 THEN 'host not supported' WHEN 4 THEN 'page inside a repository' END AS error FROM pages")
def references(spark, sf_dir):
    i = F.col("page_id").cast("string")
    shape = [F.concat(F.lit(" https://www.GitHub.com/own"), i, F.lit("/name."), i, F.lit(".git/?tab=x#y")), F.concat(F.lit("git@github.com:own"), i, F.lit("/n.git")), F.concat(F.lit("o/n"), i), F.col("url"), F.concat(F.lit("github.com/own/name/tree/"), i)]
    raw = F.element_at(F.array(*shape), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", text.reference(raw).alias("r")).select("page_id", "r.ok", "r.full_name", "r.error")


@query("SELECT p_partkey + 7 AS github_id, 'o' || p_partkey || '/n' AS full_name, 'o' || p_partkey AS owner_login, CASE WHEN p_size % 2 = 0 THEN p_size ELSE 0 END::BIGINT AS stars, FALSE AS is_fork, 'main' AS default_branch, '2020-01-02 03:04:05' AS pushed_at FROM part")
def search_payloads(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    item = F.struct(
        (F.col("p_partkey") + 7).alias("id"), F.concat(F.lit("o"), "p_partkey", F.lit("/n")).alias("full_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("stargazers_count"),
        F.lit("2020-01-02T03:04:05Z").alias("updated_at"), F.lit("never").alias("created_at"),
    )
    body = p.select(F.to_json(F.struct(F.array(item).alias("items"))).alias("body"))
    out = payloads.search_items(body, "topic:x")
    return out.where("created_at is null").select("github_id", "full_name", "owner_login", "stars", "is_fork", "default_branch", F.date_format("pushed_at", "yyyy-MM-dd HH:mm:ss").alias("pushed_at"))


@query("SELECT l_orderkey AS entity_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_quantity) AS rank, 's' || l_suppkey AS login, CAST(l_quantity AS BIGINT) AS contributions FROM lineitem WHERE l_linenumber <> 2 QUALIFY rank <= 3")
def contributor_payloads(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    one = F.struct("l_linenumber", F.col("l_suppkey").alias("id"), F.when(F.col("l_linenumber") != 2, F.concat(F.lit("s"), "l_suppkey")).alias("login"), F.col("l_quantity").cast("long").alias("contributions"))
    lists = li.groupBy(F.col("l_orderkey").alias("entity_id")).agg(F.to_json(F.sort_array(F.collect_list(one))).alias("body"))
    return payloads.contributors(lists, 3).select("entity_id", "rank", "login", "contributions")


@query("SELECT c_custkey AS id, c_name AS login, CASE WHEN c_custkey % 2 = 0 THEN 'b' END AS blog, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_nationkey END::BIGINT AS followers FROM customer")
def profile_payloads(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    body = F.to_json(F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("login"), F.when(F.col("c_custkey") % 2 == 0, "b").otherwise(" ").alias("blog"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("followers")))
    return payloads.profiles(c.select(body.alias("body"))).select("id", "login", "blog", "followers")


@query("SELECT 'phrase:' || lang AS seed, COUNT(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'topic:' || source, COUNT(*) FROM documents GROUP BY source")
def seed_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    seeds = d.select(F.concat(F.lit("q:"), "lang").alias("s")).unionByName(d.select(F.col("source").alias("s")))
    return seeds.groupBy(text.seed_label(F.col("s")).alias("seed")).agg(F.count("*").alias("n"))


@query("SELECT user_id AS id, arg_max(event_type, event_id) AS event_type, MAX(event_id) AS event_id FROM events GROUP BY user_id")
def keep_last(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return merge.keep_one(e, ["user_id"], F.desc("event_id")).select(F.col("user_id").alias("id"), "event_type", "event_id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 20)")
def missing_set(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_nationkey < 20").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(c, "o_custkey", "left_anti").select(F.col("o_orderkey").alias("id"))


def detail(spark, sf_dir, name: str):
    """One entity by name with its categories, the people shown and its series, as one row."""
    one = listing.by_name(spark_view(spark, sf_dir, "entity"), name)
    own = one.select(F.col("id").alias("entity_id"))
    chips = listing.chips(spark_view(spark, sf_dir, "assignment"), spark_view(spark, sf_dir, "category"), one)
    links = spark_view(spark, sf_dir, "link").join(own, "entity_id", "left_semi")
    shown = people.shares(links).groupBy(F.col("entity_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "person_id", "share"))).alias("people"))
    now = F.lit(spark_view(spark, sf_dir, "today").first()["now"])
    metrics = spark_view(spark, sf_dir, "metrics").join(one.select("id"), "id", "left_semi")
    points = temporal.series(metrics, one, now).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("recorded_on", "stars"))).alias("series"))
    return one.join(chips, "id", "left").join(shown, "id", "left").join(points, "id", "left")


@query(
    with_views("metrics", "today", "entity", "assignment", "category", "link").rstrip() + ", one AS (SELECT * FROM entity ORDER BY id LIMIT 1), "
    "pts AS (SELECT recorded_on, stars FROM metrics m, today WHERE m.id = (SELECT id FROM one) AND (recorded_on >= now - 90 OR recorded_on = (SELECT MAX(recorded_on) FROM metrics x, today t WHERE x.id = m.id AND x.recorded_on < t.now - 90)) UNION ALL SELECT now, stars FROM one, today WHERE id IN (SELECT id FROM metrics)), "
    "k AS (SELECT person_id, contributions, row_number() OVER (ORDER BY contributions DESC, person_id) AS rn FROM link WHERE entity_id = (SELECT id FROM one)) "
    "SELECT id, full_name, (SELECT string_agg(slug, ',' ORDER BY is_primary DESC, confidence DESC, slug) FROM assignment JOIN category USING (slug) WHERE entity_id = one.id) AS categories, "
    "(SELECT string_agg(person_id, ',' ORDER BY rn) FROM k WHERE rn <= 20) AS people, (SELECT string_agg(CAST(recorded_on AS VARCHAR) || '=' || stars, ',' ORDER BY recorded_on) FROM pts) AS series FROM one"
)
def entity_detail(spark, sf_dir):
    """The detail of the first entity, asked for in capitals."""
    name = spark_view(spark, sf_dir, "entity").orderBy("id").limit(1).first()["full_name"]
    out = detail(spark, sf_dir, name.upper())
    series = F.transform("series", lambda p: F.concat_ws("=", p["recorded_on"].cast("string"), p["stars"].cast("string")))
    return out.select("id", "full_name", F.array_join("categories", ",").alias("categories"), F.array_join(F.col("people.person_id").cast("array<string>"), ",").alias("people"), F.array_join(series, ",").alias("series"))
