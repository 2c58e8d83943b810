"""Filtered, searched, sorted and paged listings, and the detail of one entity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendlake.functions.scoring import licence_class
from trendlake.functions.text import escape_like, tokens, trimmed
from trendlake.operators import aggregates

#: Weights of a token in an entity's name, description and topics.
WEIGHTS = {"name": 1.0, "description": 0.4, "topics": 0.2}
SORTS = {
    "trending": ["trend_score"], "stars": ["stars"], "stars-today": ["stars_day"], "stars-week": ["stars_week"], "stars-month": ["stars_month"],
    "velocity": ["trend_velocity"], "quality": ["quality_score"], "newest": ["created_on"], "recently-updated": ["pushed_on"], "relevance": ["relevance"],
}
WINDOWS = {"day": "stars-today", "week": "stars-week", "month": "stars-month", "all": "trending"}


@dataclass(frozen=True)
class Listing:
    """What a listing asks for; ``check`` raises on values that are not allowed."""

    q: str | None = None
    category: str | None = None
    group: str | None = None
    language: str | None = None
    license: str | None = None
    country: str | None = None
    min_stars: int | None = None
    max_stars: int | None = None
    min_quality: int | None = None
    created_after: str | None = None
    pushed_after: str | None = None
    include_archived: bool = False
    sort: str = "trending"
    page: int = 1
    per_page: int = 24

    def check(self) -> Listing:
        if self.sort not in SORTS:
            raise ValueError(f"sort must be one of {sorted(SORTS)}")
        if self.min_quality is not None and not 0 <= self.min_quality <= 100:
            raise ValueError("min_quality must lie in 0..100")
        if self.min_stars is not None and self.max_stars is not None and self.min_stars > self.max_stars:
            raise ValueError("min_stars must not exceed max_stars")
        return self


def clamp_page(page: int, per_page: int, most: int = 100) -> tuple[int, int]:
    return max(1, page), min(most, max(1, per_page))


def postings(entities: DataFrame) -> DataFrame:
    """Search document: a row for each entity and token with its greatest weight."""

    def weighted(weight: float):
        return lambda t: F.struct(t.alias("token"), F.lit(weight).alias("weight"))

    parts = []
    for field, weight in WEIGHTS.items():
        if field in entities.columns:
            value = F.array_join(field, " ") if dict(entities.dtypes)[field].startswith("array") else F.translate(F.col(field), "/", " ")
            parts.append(F.transform(tokens(value), weighted(weight)))
    flat = entities.select("id", F.explode(F.concat(*parts)).alias("p"))
    return flat.groupBy("id", F.col("p.token").alias("token")).agg(F.max("p.weight").alias("weight"))


def matches(entities: DataFrame, q: str) -> DataFrame:
    """id, text_rank of the entities that hold every token of the query; a query without any matches none."""
    wanted = sorted({t for t in "".join(c if c.isalnum() else " " for c in q.lower()).split()})
    hits = postings(entities).where(F.col("token").isin(wanted))
    return hits.groupBy("id").agg(F.sum("weight").alias("text_rank"), F.count("*").alias("n")).where(F.col("n") == len(wanted)).drop("n")


def contains(column: Column, q: str) -> Column:
    return column.ilike(f"%{escape_like(q)}%")


def name_boost(q: str, full_name: Column, name: Column) -> Column:
    """1.0 where the full name begins with the query, 0.8 where the name does, 0.4 where it holds it."""
    like = escape_like(q)
    return (
        F.when(full_name.ilike(f"{like}%"), 1.0).when(name.ilike(f"{like}%"), 0.8).when(full_name.ilike(f"%{like}%"), 0.4).otherwise(0.0)
    )


def in_category(entities: DataFrame, assignment: DataFrame, category: DataFrame, slug: str | None = None, group: str | None = None) -> DataFrame:
    """Entities whose primary category (or its group) is the given one; no row is multiplied."""
    chosen = category
    if slug:
        chosen = chosen.where(F.col("slug") == slug)
    if group:
        chosen = chosen.where(F.col("group_slug") == group)
    primary = assignment.where("is_primary").join(chosen.select("slug"), "slug", "left_semi")
    return entities.join(primary.select(F.col("entity_id").alias("id")), "id", "left_semi")


def filtered(entities: DataFrame, p: Listing, assignment: DataFrame | None = None, category: DataFrame | None = None) -> DataFrame:
    """Active entities that pass every given filter, with ``relevance`` (0 without a query)."""
    df = entities.where("status = 'active'")
    if not p.include_archived:
        df = df.where("not is_archived")
    for column, value in (("language", p.language), ("owner_country", p.country)):
        if value:
            df = df.where(F.col(column) == value)
    for test, value in (("stars >= {}", p.min_stars), ("stars <= {}", p.max_stars), ("quality_score >= {}", p.min_quality)):
        if value is not None:
            df = df.where(test.format(int(value)))
    for column, value in (("created_on", p.created_after), ("pushed_on", p.pushed_after)):
        if value:
            df = df.where(F.col(column) >= F.lit(value).cast("date"))
    if p.license:
        df = df.where(licence_class(F.col("license_spdx_id")) == p.license)
    if p.category or p.group:
        df = in_category(df, assignment, category, p.category, p.group)
    q = (p.q or "").strip()
    if not q:
        return df.withColumn("relevance", F.lit(0.0))
    ranked = df.join(matches(df, q), "id", "left")
    ranked = ranked.where(F.col("text_rank").isNotNull() | contains(F.col("full_name"), q) | contains(F.coalesce("description", F.lit("")), q))
    return ranked.withColumn("relevance", F.coalesce("text_rank", F.lit(0.0)) + name_boost(q, F.col("full_name"), F.col("name"))).drop("text_rank")


def ordering(p: Listing) -> list[Column]:
    """Greatest first, nulls last, the id breaking ties; relevance without a query is trending."""
    sort = "trending" if p.sort == "relevance" and not (p.q or "").strip() else p.sort
    return [*[F.desc_nulls_last(c) for c in SORTS[sort]], F.desc("id")]


def page(df: DataFrame, order: list[Column], number: int, per_page: int, most: int = 100) -> DataFrame:
    """One page with ``total`` beside each row: a top-k and a one-row count, never a global window."""
    number, per_page = clamp_page(number, per_page, most)
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset((number - 1) * per_page).limit(per_page)
    return rows.join(F.broadcast(total))


def page_frame(df: DataFrame, order: list[Column], number: int, per_page: int, most: int = 100) -> DataFrame:
    """One row: total, page, per_page, total_pages, start_rank and the page's rows as ``items``.

    A page past the end has its true totals and no items.
    """
    number, per_page = clamp_page(number, per_page, most)
    total = df.agg(F.count("*").alias("total"))
    nth = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))  # of at most ``most`` sorted rows
    rows = df.orderBy(*order).offset((number - 1) * per_page).limit(per_page).select(F.struct(*df.columns).alias("row"))
    items = rows.withColumn("nth", nth).agg(F.sort_array(F.collect_list(F.struct("nth", "row"))).alias("items"))
    return total.join(items).select(
        "total", F.lit(number).alias("page"), F.lit(per_page).alias("per_page"),
        F.ceil(F.col("total") / per_page).cast("long").alias("total_pages"), F.lit((number - 1) * per_page + 1).cast("long").alias("start_rank"),
        F.col("items.row").alias("items"),
    )


def facets(entities: DataFrame, assignment: DataFrame) -> DataFrame:
    """facet, value, n over active entities: their languages, countries and primary categories, and all of them.

    One reading of the entities, each with its primary category, and one grouping by four sets.
    """
    primary = assignment.where("is_primary").groupBy(F.col("entity_id").alias("id")).agg(F.collect_set("slug").alias("slugs"))
    active = entities.where("status = 'active'").select("id", "language", F.col("owner_country").alias("country")).join(primary, "id", "left")
    # an entity of several primaries counts once but in each of them
    each = active.select("language", "country", F.posexplode_outer("slugs").alias("nth", "category"))
    once = F.count_if(F.coalesce(F.col("nth"), F.lit(0)) == 0)
    g = each.groupingSets([["language"], ["country"], ["category"], []], "language", "country", "category").agg(F.grouping_id().alias("set"), once.alias("once"), F.count("*").alias("rows"))
    names = {3: ("language", F.col("language")), 5: ("country", F.col("country")), 6: ("category", F.col("category")), 7: ("all", F.lit("all"))}
    facet, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for number, (name, c) in names.items():
        facet, value = F.when(F.col("set") == number, name).otherwise(facet), F.when(F.col("set") == number, c).otherwise(value)
    out = g.select(facet.alias("facet"), value.alias("value"), F.when(F.col("set") == 6, F.col("rows")).otherwise(F.col("once")).alias("n"))
    return out.where("value is not null and n > 0")


def home(entities: DataFrame, rows: int = 8) -> DataFrame:
    """list, place and id of the lists that a visitor meets first: trending by two windows, newest, best of quality 60 and more."""
    lists = {"trending-day": Listing(sort="stars-today"), "trending-week": Listing(sort="stars-week"), "newest": Listing(sort="newest"), "quality": Listing(sort="quality", min_quality=60)}
    out = None
    for name, p in lists.items():
        frame = page_frame(filtered(entities, p).select("id", *SORTS[p.sort]), ordering(p), 1, rows)
        part = frame.select(F.lit(name).alias("list"), F.posexplode("items.id").alias("place", "id"))
        out = part if out is None else out.unionByName(part)
    return out.select("list", (F.col("place") + 1).alias("place"), "id")


def home_page(entities: DataFrame, people: DataFrame, category: DataFrame, assignment: DataFrame, groups: DataFrame, since: Column, rows: int = 8) -> DataFrame:
    """section, name, place and value of everything on the first page.

    ``total``: a row for each figure of the global statistics; ``list``: ids by place in each list of :func:`home`; ``group``:
    entities of each group of categories in the taxonomy's order.
    """
    totals = aggregates.global_stats(entities, people, category, since)
    totals = totals.select([F.col(c).cast("long").alias(c) for c in totals.columns]).unpivot([], totals.columns, "name", "value")
    by_group = aggregates.ordered_groups(aggregates.category_stats(entities, assignment, category), groups)
    parts = {"total": (totals, "name", F.lit(0), "value"), "list": (home(entities, rows), "list", F.col("place"), "id"), "group": (by_group, "group_slug", F.col("place"), "n")}
    out = None
    for section, (df, name, place, value) in parts.items():
        part = df.select(F.lit(section).alias("section"), F.col(name).alias("name"), place.cast("int").alias("place"), F.col(value).cast("long").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def chips(assignment: DataFrame, category: DataFrame, ids: DataFrame) -> DataFrame:
    """Per entity its category slugs: primary first, then by falling confidence."""
    mine = assignment.join(ids.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").join(category, "slug")
    order = F.struct((~F.col("is_primary")).alias("a"), (-F.col("confidence")).alias("b"), "slug")
    return mine.groupBy(F.col("entity_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(order)), lambda s: s["slug"]).alias("categories"))


def list_entities(entities: DataFrame, p: Listing, assignment: DataFrame, category: DataFrame) -> DataFrame:
    """A page of the listing: licence class, categories and the exact total beside every row."""
    p = p.check()
    rows = page(filtered(entities, p, assignment, category), ordering(p), p.page, p.per_page)
    rows = rows.join(chips(assignment, category, rows), "id", "left")
    return rows.withColumn("license_class", licence_class(F.col("license_spdx_id")))


def trending(entities: DataFrame, window: str, limit: int, assignment: DataFrame, category: DataFrame) -> DataFrame:
    return list_entities(entities, Listing(sort=WINDOWS[window], per_page=limit), assignment, category)


def by_name(entities: DataFrame, name: str) -> DataFrame:
    """The entity of that full name: an exact hit before one in other letters; none without a slash."""
    wanted = name.strip().strip("/")
    if "/" not in wanted:
        return entities.limit(0)
    hits = entities.where(F.lower("full_name") == wanted.lower())
    return hits.orderBy((F.col("full_name") != wanted).cast("int"), "id").limit(1)


def work_queue(df: DataFrame, column: str, limit: int, *more: Column) -> DataFrame:
    """Never attempted rows first, then the longest waiting ones."""
    return df.orderBy(F.asc_nulls_first(column), *more, "id").limit(limit)


def blank(column: Column) -> Column:
    return trimmed(F.coalesce(column, F.lit(""))) == ""
