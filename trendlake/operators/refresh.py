"""Refreshing what is known: names, profiles, people, seeds, and the daily run of all stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlake.functions import text
from trendlake.operators import classify, merge, people, places, scores, temporal
from trendlake.storage import materialize
from trendlake.versions import Tables


def resolve(entities: DataFrame, fetched: DataFrame) -> DataFrame:
    """``entities(id, github_id, full_name)`` with the fetched row of each and whether it was renamed.

    A row is found by its stable id, else by its name in any letters; those without one are left out.
    Of several fetched rows of one id or name the greatest full name counts.
    """
    row = F.struct(*fetched.columns)
    by_id = fetched.where("github_id is not null").groupBy("github_id").agg(F.max_by(row, "full_name").alias("__by_id"))
    by_name = fetched.groupBy(F.lower("full_name").alias("__name")).agg(F.max_by(row, "full_name").alias("__by_name"))
    found = entities.join(by_id, "github_id", "left").join(by_name, F.lower("full_name") == F.col("__name"), "left")
    found = found.withColumn("fetched", F.coalesce("__by_id", "__by_name")).where("fetched is not null")
    return found.select(*entities.columns, "fetched", (F.col("fetched.full_name") != F.col("full_name")).alias("renamed"))


def stamp(entities: DataFrame, touched: DataFrame, gone: DataFrame, now: Column) -> DataFrame:
    """``synced_on`` set for touched and gone ids; gone ones are rejected if they were active, else left alone."""
    marks = touched.select("id", F.lit(False).alias("gone")).unionByName(gone.select("id", F.lit(True).alias("gone")))
    marks = marks.groupBy("id").agg(F.bool_or(~F.col("gone")).alias("__touched"), F.bool_or("gone").alias("__gone"))
    out = entities.join(marks, "id", "left")
    leaves = F.coalesce("__gone", F.lit(False)) & (F.col("status") == "active")
    set_ = {
        "synced_on": F.when(F.coalesce("__touched", F.lit(False)) | leaves, now).otherwise(F.col("synced_on")),
        "status": F.when(leaves, "rejected").otherwise(F.col("status")),
    }
    return out.select(*[set_[c].alias(c) if c in set_ else F.col(c) for c in entities.columns])


def readme_queue(entities: DataFrame, refreshed: DataFrame, limit: int = 200) -> DataFrame:
    """Refreshed entities without a README, the first ``limit`` by id."""
    return entities.where("readme_length is null").join(refreshed.select("id"), "id", "left_semi").orderBy("id").limit(limit)


def persist_people(person: DataFrame, link: DataFrame, entities: DataFrame, found: DataFrame, measured: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The next person, link and entity tables after ``found(entity_id, github_id, login, avatar_url, contributions)``.

    People are met by ``github_id`` and keep an avatar that a new row lacks; new ones get the ids behind the
    last. A login is held by one person: of several ids that come with it the lowest, and whoever held it before
    becomes ``login:github_id``. Of several rows of one person in one entity the strongest counts; 30 links an entity are
    stored. ``contributors_count`` is what was found, or where the list is full the lower bound in
    ``measured(entity_id, count)``; the top share is that among the first hundred.
    """
    found = found.where("github_id > 0")
    folk = found.groupBy("github_id").agg(F.max("login").alias("login"), F.max("avatar_url").alias("avatar_url"))
    # of several ids under one login the lowest stays, and takes the others' links
    kept = folk.groupBy("login").agg(F.min("github_id").alias("__kept"))
    into = folk.join(kept, "login").select("github_id", "__kept")
    found = found.join(into, "github_id").withColumn("github_id", F.col("__kept")).drop("__kept")
    folk = folk.join(kept.select(F.col("__kept").alias("github_id")), "github_id", "left_semi")
    # a login that another id takes is released first
    claims = folk.select("login", F.col("github_id").alias("__by"))
    lost = F.col("__by").isNotNull() & (F.col("__by") != F.col("github_id"))
    released = F.when(lost, F.concat_ws(":", "login", F.col("github_id").cast("string"))).otherwise(F.col("login"))
    person = person.join(claims, "login", "left").withColumn("login", released).select(*person.columns)
    last = person.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
    fresh = folk.join(person.select("github_id"), "github_id", "left_anti").select("github_id").join(last)  # one row
    # ids need not be dense: the stable id, moved behind the last
    fresh = fresh.select("github_id", (F.col("__last") + F.col("github_id") + 1).alias("id"))
    known = person.select("github_id", "id").unionByName(fresh)
    people_ = merge.upsert(person, folk.join(known, "github_id"), ["github_id"], {"avatar_url": "fill", "id": "keep"}).select(*person.columns)
    best = materialize(found.join(known, "github_id").groupBy("entity_id", F.col("id").alias("person_id")).agg(F.max("contributions").alias("contributions")), "best")
    stored = people.ranked(best).where(F.col("rank") <= people.STORED)
    links = merge.upsert(link, stored, ["entity_id", "person_id"]).select(*link.columns)
    shares = people.concentration(best).withColumnRenamed("entity_id", "id")
    if measured is not None:
        more = measured.select(F.col("entity_id").alias("id"), F.col("count").alias("__measured"))
        full = F.col("contributors_count") >= people.DENOMINATOR
        shares = shares.join(more, "id", "left").withColumn("contributors_count", F.when(full, F.coalesce("__measured", "contributors_count")).otherwise(F.col("contributors_count")))
    shares = shares.select("id", "contributors_count", "top_contributor_share")
    return people_, links, merge.upsert(entities, shares, ["id"]).where("not is_new").select(*entities.columns)


def refresh_profiles(person: DataFrame, profiles: DataFrame, aliases: DataFrame, nowhere: DataFrame, now: Column) -> DataFrame:
    """People with the fetched profile of their login written over, its place resolved and the stamp set; of several profiles of one login the greatest counts."""
    profiles = profiles.groupBy("login").agg(F.max(F.struct(*[c for c in profiles.columns if c != "login"])).alias("p")).select("login", "p.*")
    place = places.resolve(profiles.select(F.col("login").alias("id"), "location"), aliases, nowhere).select(F.col("id").alias("login"), "country", "city")
    new = profiles.drop("id").join(place, "login").withColumn("synced_on", now)
    return merge.upsert(person, new, ["login"]).where("not is_new").select(*person.columns)


def seed_categories(category: DataFrame, groups: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Categories upserted by slug from ``taxonomy(slug, group_slug, place)``.

    ``sort_order`` is a thousand times the place of the group in ``groups(group_slug, place)`` (99 where
    unknown) plus the category's own place.
    """
    at = groups.select("group_slug", F.col("place").alias("__group"))
    order = F.coalesce("__group", F.lit(99)) * 1000 + F.col("place")
    new = taxonomy.join(F.broadcast(at), "group_slug", "left").select("slug", "group_slug", order.cast("long").alias("sort_order"))
    return merge.upsert(category, new, ["slug"]).select(*category.columns)


#: Rows of one list when counted rows are written out again.
COPIES = 10_000


def named_intake(raw: DataFrame, column: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Rows to upsert for the references in ``raw``, one for each name in any letters, and the faulty ones, as often as they come.

    Equal references are counted first and read once.
    """
    read = merge.read_once(raw.select(F.col(column).alias("raw")), "raw")
    good = read.where("r.ok").groupBy(F.lower("r.full_name").alias("__name")).agg(F.min("r.full_name").alias("full_name"))
    good = good.select("full_name", F.substring_index("full_name", "/", 1).alias("owner_login"), F.lit("manual:add").alias("discovery_source"))
    bad = read.where("not r.ok").select("raw", F.col("r.error").alias("error"), "n")
    # as many rows as there were, by two short lists
    bad = bad.withColumn("__k", F.explode(F.expr(f"sequence(0, (n - 1) div {COPIES})")))
    bad = bad.withColumn("__i", F.explode(F.array_repeat(F.lit(0), F.least(F.col("n") - F.col("__k") * COPIES, F.lit(COPIES)).cast("int"))))
    return good, bad.select("raw", "error")


def intake(raw: DataFrame, fetched: DataFrame, column: str = "raw") -> tuple[DataFrame, DataFrame]:
    """Rows to discover for the references in ``raw``, and the references that bring none, with the reason.

    A reference takes the fetched row of its name in any letters (the greatest of several); it is marked ``manual:add``, and has no
    ``synced_on`` or ``classified_on``, so that new entities lead the queues.
    """
    good, bad = named_intake(raw, column)
    own = [c for c in fetched.columns if c not in ("synced_on", "classified_on", "discovery_source")]
    row = fetched.groupBy(F.lower("full_name").alias("__name")).agg(F.max(F.struct("full_name", *[c for c in own if c != "full_name"])).alias("__row"))
    met = good.join(row, F.lower("full_name") == F.col("__name"), "left")
    rows = met.where("__row is not null").select("__row.*", "discovery_source")
    return rows, bad.unionByName(met.where("__row is null").select(F.col("full_name").alias("raw"), F.lit("not found").alias("error")))


#: What a named intake does, in this order.
INTAKE = ("discover", "classify", "score")
STAGES = ("discover", "sync", "snapshot", "countries", "contributors", "profiles", "classify", "score")


class Day:
    """One daily run over versioned tables: every stage reads the newest version and changes it in one step.

    Tables: entity, metrics, person, link, assignment. ``found`` holds what was fetched: ``discovered``, ``refreshed``,
    ``people`` as for :func:`persist_people`, ``profiles`` as for :func:`refresh_profiles`, ``external`` labels of
    :func:`classify.merge_external`; what is missing skips its stage. Stages come in their one order, with one ``now``: a snapshot is taken before
    anything that may fail, and scores come last. A run that was cut goes on behind its last stage, and the
    same stages never count twice.
    """

    def __init__(self, tables: Tables, found: dict[str, DataFrame], rules: DataFrame, aliases: DataFrame, nowhere: DataFrame, now: Column, run: str) -> None:
        self.tables, self.found, self.rules, self.aliases, self.nowhere, self.now, self.run_name = tables, found, rules, aliases, nowhere, now, run
        self.figures: dict[str, int] = {}

    def run(self, stages: tuple[str, ...] = STAGES) -> dict[str, int]:
        """All stages that are not done; the figures of the scoring pass, if it ran."""
        done = self.tables.done(self.run_name)
        for stage in stages:
            if stage not in done:
                changed = getattr(self, stage)()
                rows, gone = changed if isinstance(changed, tuple) else (changed, None)
                self.tables.change(self.run_name, stage, rows, gone)
                if stage == "score":
                    self.figures = self._figures.get()
        return self.figures

    def _once(self, name: str) -> DataFrame:
        """What was fetched, worked out once: a stage reads it more often."""
        return materialize(self.found[name], name)

    def discover(self) -> dict[str, DataFrame]:
        return {"entity": merge.discovered(self.tables.read("entity"), self._once("discovered"))} if "discovered" in self.found else {}

    def sync(self) -> dict[str, DataFrame]:
        if "refreshed" not in self.found:
            return {}
        entity, new = self.tables.read("entity"), self.found["refreshed"]
        fill = {c: "fill" for c in new.columns if c != "id"}
        return {"entity": merge.upsert(entity, new, ["id"], fill).where("touched and not is_new").select(*entity.columns)}

    def snapshot(self) -> dict[str, DataFrame]:
        entity, metrics = self.tables.read("entity"), self.tables.read("metrics")
        counts = [F.col(c) if c in entity.columns else F.lit(None).cast("long").alias(c) for c in temporal.COUNTERS]
        rows = temporal.changed_rows(entity.where("status = 'active'").select("id", *counts), metrics, self.now)
        if "month" in metrics.columns:
            rows = rows.withColumn("month", F.date_format("recorded_on", "yyyy-MM"))
        return {"metrics": rows, "entity": scores.gained(entity, metrics, self.now)}

    def countries(self) -> dict[str, DataFrame]:
        entity = self.tables.read("entity")
        found = places.resolve(entity.select("id", F.col("owner_location").alias("location")), self.aliases, self.nowhere)
        new = entity.select("id", F.col("owner_country").alias("__was")).join(places.backfill(entity, found), "id")
        return {"entity": new.where(~F.col("owner_country").eqNullSafe(F.col("__was"))).select(*entity.columns)}

    def contributors(self) -> dict[str, DataFrame]:
        if "people" not in self.found:
            return {}
        old = [self.tables.read(n) for n in ("person", "link", "entity")]
        new = persist_people(*old, self._once("people"))
        return {n: _unlike(before, after, keys) for n, before, after, keys in zip(("person", "link", "entity"), old, new, (["id"], ["entity_id", "person_id"], ["id"]), strict=True)}

    def profiles(self) -> dict[str, DataFrame]:
        if "profiles" not in self.found:
            return {}
        person = self.tables.read("person")
        return {"person": _unlike(person, refresh_profiles(person, self.found["profiles"], self.aliases, self.nowhere, self.now), ["id"])}

    def classify(self) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        entity, old = self.tables.read("entity"), self.tables.read("assignment")
        marked = entity.withColumn("fingerprint", text.fingerprint(*[F.col(c) for c in ("name", "description", "topics", "language", "readme")]))
        # both watermarks: never tried, or touched since
        waits = F.col("classified_on").isNull() | F.col("synced_on").isNull() | (F.col("classified_on") <= F.col("synced_on"))
        due = materialize(classify.pending(marked.where(waits & (F.col("status") == "active")), old), "due")
        manual = old.where("source = 'manual'")
        placed = classify.expand(classify.decide(classify.scores(classify.hits(due, self.rules))), due, manual).withColumn("source", F.lit("rule"))
        if "external" in self.found:
            placed = classify.with_external(placed, self.found["external"].join(due.select("id"), "id", "left_semi"), due, manual)
        gone = old.where("source <> 'manual'").join(due.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
        tried = classify.attempted(entity.join(due.select("id"), "id", "left_semi"), due, self.now)
        return {"assignment": placed.select(*old.columns), "entity": tried.select(*entity.columns)}, {"assignment": gone}

    def score(self) -> dict[str, DataFrame]:
        self._figures = scores.Figures()
        return {"entity": scores.changed(self.tables.read("entity"), self.tables.read("metrics"), self.now, self._figures)}


def _unlike(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``after`` that are new or unlike those of equal keys before."""
    old = before.select(*keys, F.struct(*before.columns).alias("__old"))
    new = after.select(*before.columns).withColumn("__new", F.struct(*before.columns)).join(old, keys, "left")
    return new.where(~F.col("__new").eqNullSafe(F.col("__old"))).select(*before.columns)
