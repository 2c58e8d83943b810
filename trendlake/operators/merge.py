"""Upserts as merges of an old and a new frame into the next version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendlake.functions import text


def keep_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", n).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], rules: dict[str, str] | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Old rows updated by new ones with equal keys, new ones inserted.

    ``rules`` gives a column's rule: ``new`` (default where the new frame has it), ``keep`` (the
    old value stays), ``fill`` (new, or old where new is null), ``most`` (the greater). Columns in
    ``extra`` are computed from structs ``o`` and ``n``; either is null where its side is missing.
    Of several new rows of one key the greatest counts, compared column by column; a null key meets none.
    """
    rules, extra = rules or {}, extra or {}
    o = old.select(*keys, F.struct(*old.columns).alias("o"))
    n = new.groupBy(*keys).agg(F.max(F.struct(*new.columns)).alias("n"))  # dealt by the keys, as the join asks
    both = o.join(n, keys, "full_outer")
    out = []
    for c in old.columns:
        ov, nv = F.col("o")[c], F.col("n")[c] if c in new.columns else F.lit(None)
        rule = rules.get(c, "new" if c in new.columns else "keep")
        if c in keys:
            value = F.col(c)
        elif c in extra:
            value = extra[c]
        elif rule == "keep":
            value = F.when(F.col("o").isNotNull(), ov).otherwise(nv)
        elif rule == "fill":
            value = F.coalesce(nv, ov)
        elif rule == "most":
            value = F.greatest(ov, nv)
        else:
            value = F.when(F.col("n").isNotNull(), nv).otherwise(ov)
        out.append(value.alias(c))
    return both.select(*out, F.col("o").isNull().alias("is_new"), F.col("n").isNotNull().alias("touched"))


def changed_only(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of ``new`` with any of ``columns`` unlike the old row's (nulls compared as values)."""
    before = old.select(key, F.struct(*columns).alias("__old"))
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col("__old")[c])
    return new.join(before, key).where(differs).drop("__old")


def release_names(old: DataFrame, incoming: DataFrame, stable: str = "github_id", name: str = "full_name") -> DataFrame:
    """``old`` with names that an incoming row of another stable id takes marked as superseded and rejected."""
    taken = incoming.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(stable).alias("__by"))
    hit = F.col("__by").isNotNull() & (F.col("__by") != F.col(stable))
    marked = old.join(taken, name, "left")
    out = {
        name: F.when(hit, F.concat(F.col(name), F.lit("#superseded-"), F.col("id").cast("string"))).otherwise(F.col(name)),
        "status": F.when(hit, "rejected").otherwise(F.col("status")),
    }
    return marked.select(*[out[c].alias(c) if c in out else F.col(c) for c in old.columns])


def discovered(entity: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of ``entity`` that discovery changes or adds, names that moved released first.

    Found rows without a stable id are passed over, and of several rows of one id the greatest counts. Ids, status,
    how and when an entity was first found stay; a new description, language or list of topics resets the watermark ``classified_on``.
    """
    seen = found.where("github_id is not null and github_id <> 0")
    before = release_names(entity, seen) if "full_name" in found.columns else entity
    reset = F.lit(False)
    for c in [c for c in ("description", "topics", "language") if c in found.columns]:
        reset = reset | ~F.col("o")[c].eqNullSafe(F.col("n")[c])
    extra = {}
    if "classified_on" in entity.columns:
        kept = F.col("o.classified_on")
        extra["classified_on"] = F.when(F.col("n").isNull(), kept).when(F.col("o").isNotNull() & ~reset, kept)
    if "id" not in seen.columns:  # ids need not be dense: the stable id, moved behind the last
        last = entity.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__last"))
        seen = seen.join(last).withColumn("id", F.col("__last") + F.col("github_id") + 1).drop("__last")  # one row
    if "status" not in seen.columns:
        seen = seen.withColumn("status", F.lit("active"))
    out = upsert(before, seen, ["github_id"], {c: "keep" for c in ("id", "status", "discovery_source", "first_seen_on")}, extra)
    if "full_name" in found.columns:
        taken = entity.select(F.col("github_id").alias("__g"), F.col("full_name").alias("__was"))
        out = out.join(taken, out["github_id"] == taken["__g"], "left")
        out = out.withColumn("touched", F.col("touched") | ~F.col("full_name").eqNullSafe(F.col("__was")))
    return out.where("touched").select(*entity.columns)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows to append, one for each absent key, and the rows that were there already."""
    fresh = new.join(old.select(key), key, "left_anti").dropDuplicates([key])
    return fresh, new.join(old.select(key), key, "left_semi")


def read_once(raw: DataFrame, column: str) -> DataFrame:
    """The different rows of ``raw``, n, the number of each, and r, the reference in ``column``."""
    spelled = raw.groupBy(*raw.columns).agg(F.count("*").alias("n"))
    # what is read hangs on the count, or a filter on it would move below the grouping and read every row
    return spelled.withColumn("r", text.reference(F.when(F.col("n") > 0, F.col(column))))


def submissions(old: DataFrame, raw: DataFrame, column: str = "url", note: str = "note") -> DataFrame:
    """What becomes of submitted references: raw, note, url, full_name, outcome, error and n, the number of such rows.

    ``old(url)`` holds what was submitted before. A reference is read by :func:`text.reference`; of the rows of one address the
    one with the least raw text and note is ``new`` (to append), all others are ``repeated``, as are all rows of an address
    in ``old``. What is no reference is ``faulty``, with the reason.
    """
    # equal rows are counted first, so that what everyone submits is one row when addresses meet
    read = read_once(raw.select(F.col(column).alias("raw"), F.col(note).alias("note")), "raw").select("raw", "note", "n", "r.ok", "r.url", "r.full_name", "r.error")
    this = F.struct("raw", "note")
    first = read.where("ok").groupBy("url").agg(F.min(this).alias("first")).join(old.select("url").distinct(), "url", "left_anti")
    placed = read.join(first, "url", "left").withColumn("is_new", this.eqNullSafe(F.col("first")))
    parts = F.when(~F.col("ok"), F.array(F.struct(F.lit("faulty").alias("outcome"), F.col("n"))))
    parts = parts.when(F.col("is_new"), F.array(F.struct(F.lit("new").alias("outcome"), F.lit(1).cast("long").alias("n")), F.struct(F.lit("repeated").alias("outcome"), (F.col("n") - 1).alias("n"))))
    parts = parts.otherwise(F.array(F.struct(F.lit("repeated").alias("outcome"), F.col("n"))))
    return placed.withColumn("p", F.explode(parts)).where("p.n > 0").select("raw", "note", "url", "full_name", "p.outcome", "error", "p.n")


def replace_automatic(old: DataFrame, new: DataFrame, touched: DataFrame, entity: str = "entity_id", pair: tuple[str, ...] = ("entity_id", "slug")) -> DataFrame:
    """Assignments with the automatic rows of touched entities replaced; manual rows always stay."""
    kept = old.where("source = 'manual'").unionByName(old.where("source <> 'manual'").join(touched.select(entity), entity, "left_anti"))
    manual = old.where("source = 'manual'").select(*pair)
    return kept.unionByName(new.join(manual, list(pair), "left_anti").select(*old.columns))


def fold_people(people: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One person for each login (the lowest id); links redirected, the strongest of a pair kept."""
    low = people.groupBy("login").agg(F.min("id").alias("kept"))
    mapped = people.join(low, "login").select(F.col("id").alias("person_id"), "kept")
    moved = links.join(mapped, "person_id").select("entity_id", F.col("kept").alias("person_id"), "contributions")
    strongest = moved.groupBy("entity_id", "person_id").agg(F.max("contributions").alias("contributions"))
    return people.join(low.select(F.col("kept").alias("id")), "id", "left_semi"), strongest
