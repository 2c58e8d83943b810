"""Rule-based classification with evidence, confidence and an incremental cache.

Rules are a table (category, ordinal, kind, term). A phrase is keyed by its first word, or where it has no Latin word by
its first two characters, and meets the texts that hold this key by equality; of those, the texts that hold its words in
a row are confirmed by pattern. Phrases of any length, script and number take this one way; up to ``LITERALS`` keys are
literals of the plan as well, so that other words never become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendlake.functions.scoring import fixed
from trendlake.functions.text import phrase_pattern_column, topic_set

# Points of a hit, README hits that count, the routing threshold.
POINTS = {"topic": 10, "name": 6, "desc": 3, "readme": 1}
README_CAP, ACCEPT = 4, 0.5
RULES_LIMIT, LITERALS = 100_000, 5_000
#: Characters of a piece of evidence.
EVIDENCE = 500


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def other_runs(text: Column) -> Column:
    """Runs of characters that are not ASCII, in lower case."""
    return F.filter(F.split(F.lower(text), r"[\x00-\x7F]+"), lambda t: t != "")


def phrase_key(term: Column) -> Column:
    """What a text must hold to hold the phrase: its first Latin word, else two other characters, else nothing."""
    return F.coalesce(F.get(words_of(term), F.lit(0)), F.substring(F.get(other_runs(term), F.lit(0)), 1, 2), F.lit(""))


def text_keys(text: Column, others: bool) -> Column:
    """All keys of phrases that a text may hold; ``others``: those without Latin words too."""
    if not others:
        return F.array_distinct(words_of(text))
    pairs = F.transform(other_runs(text), lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.substring(r, i, F.lit(2))))
    singles = F.transform(other_runs(text), lambda r: F.split(r, ""))
    return F.array_distinct(F.concat(words_of(text), F.flatten(pairs), F.flatten(singles), F.array(F.lit(""))))


def hits(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """id, category, ordinal, field and term of every confirmed rule."""
    hint = F.broadcast if rules.limit(RULES_LIMIT + 1).count() <= RULES_LIMIT else lambda d: d
    topic_rules = rules.where("kind = 'topic'").select("category", "ordinal", "term", F.lower("term").alias("topic"))
    by_topic = entities.select("id", F.explode(topic_set(F.col("topics"))).alias("topic")).join(hint(topic_rules), "topic")
    by_topic = by_topic.select("id", "category", "ordinal", F.lit("topic").alias("field"), "term")
    spaced = lambda words: F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    phrases = rules.where("kind = 'phrase' and trim(term) <> ''").select(
        "category", "ordinal", "term", phrase_key(F.col("term")).alias("key"), phrase_pattern_column(F.col("term")).alias("pattern"),
        F.when(F.size(words_of(F.col("term"))) > 0, spaced(words_of(F.col("term")))).otherwise("").alias("run"),
    )
    fields = F.array(
        *[
            F.struct(F.lit(n).alias("field"), F.coalesce(c, F.lit("")).alias("text"))
            for n, c in (("name", F.col("name")), ("desc", F.col("description")), ("readme", F.substring("readme", 1, 4000)))
        ]
    )
    texts = entities.select("id", F.explode(fields).alias("f")).select("id", "f.field", "f.text")
    known = sorted(r[0] for r in phrases.select("key").distinct().limit(LITERALS + 1).collect())
    others = phrases.where(~F.col("key").rlike("^[a-z0-9]")).limit(1).count() > 0
    keys = text_keys(F.col("text"), others)
    if len(known) <= LITERALS:
        keys = F.filter(keys, lambda k: k.isin(known) if known else F.lit(False))
    texts = texts.withColumn("keys", keys).where(F.size("keys") > 0).withColumn("words", spaced(words_of(F.col("text"))))
    found = texts.withColumn("key", F.explode("keys")).join(hint(phrases), "key").where(F.expr("contains(words, run) and text rlike pattern"))
    return by_topic.unionByName(found.select("id", "category", "ordinal", "field", "term"))


def scores(found: DataFrame) -> DataFrame:
    """Points of each entity and category, and the evidence in a fixed order."""
    counts = found.groupBy("id", "category", "ordinal").agg(
        *[F.count_if(F.col("field") == f).alias(f) for f in POINTS],
        F.array_sort(F.collect_set(F.substring(F.concat_ws(":", "field", "term"), 1, EVIDENCE))).alias("matched"),
    )
    total = F.least("readme", F.lit(README_CAP)) * POINTS["readme"]
    for f in ("topic", "name", "desc"):
        total = total + F.col(f) * POINTS[f]
    return counts.select("id", "category", "ordinal", total.alias("score"), "matched")


def decide(scored: DataFrame) -> DataFrame:
    """Per entity the primary category, up to three secondaries, confidence and the evidence of each."""
    w = Window.partitionBy("id").orderBy(F.desc("score"), "ordinal")
    placed = scored.withColumn("n", F.row_number().over(w)).withColumn("top", F.first("score").over(w)).where("n <= 4")
    near = (F.col("n") > 1) & (F.col("score") >= F.greatest(F.lit(6.0), F.col("top") * 0.45))
    g = placed.groupBy("id").agg(
        F.max(F.when(F.col("n") == 1, F.col("category"))).alias("primary_category"),
        F.max(F.when(F.col("n") == 1, F.col("matched"))).alias("matched"),
        F.sort_array(F.collect_list(F.when(near, F.struct("n", "category", "matched")))).alias("others"),
        F.max("top").alias("top"),
        F.coalesce(F.max(F.when(F.col("n") == 2, F.col("score"))), F.lit(0)).alias("second"),
    )
    one = F.lit(1.0)
    sure = F.least(one, F.col("top") / 20) * 0.5 + F.least(one, (F.col("top") - F.col("second")) / 10) * 0.5
    return g.select(
        "id", "primary_category", F.col("others.category").alias("secondary"), fixed(sure, 3).alias("confidence"), "matched", F.col("others.matched").alias("secondary_matched")
    )


def route(decided: DataFrame, external: bool = True) -> DataFrame:
    """accept, escalate (or accept-low without an external labeller), or unclassified."""
    low = F.lit("escalate" if external else "accept-low")
    return decided.withColumn("route", F.when(F.col("primary_category").isNull(), "unclassified").when(F.col("confidence") >= ACCEPT, "accept").otherwise(low))


def pending(entities: DataFrame, assignment: DataFrame, force: bool = False) -> DataFrame:
    """Entities whose fingerprint is not in the evidence of all automatic rows; all-manual ones are skipped."""
    own = assignment.join(entities.select(F.col("id").alias("entity_id"), "fingerprint"), "entity_id")
    state = own.groupBy(F.col("entity_id").alias("id")).agg(
        F.bool_and(F.when(F.col("source") != "manual", F.array_contains("evidence", F.col("fingerprint")))).alias("cached"),
        F.bool_and(F.col("source") == "manual").alias("manual"),
    )
    df = entities.join(state, "id", "left").where(~F.coalesce("manual", F.lit(False)))
    return (df if force else df.where(~F.coalesce("cached", F.lit(False)))).drop("cached", "manual")


def expand(decided: DataFrame, entities: DataFrame, manual: DataFrame | None = None) -> DataFrame:
    """Assignments: the primary with 8 pieces of evidence, secondaries at 0.6 of its confidence with 6.

    The fingerprint in ``entities(id, fingerprint)`` comes first in the evidence, where :func:`pending`
    looks for it. Categories that ``manual(entity_id, slug)`` holds for an entity are left to it.
    """

    def row(slug: Column, primary: bool, conf: Column, matched: Column, n: int) -> Column:
        evidence = F.concat(F.array("fingerprint"), F.slice(matched, 1, n))
        return F.struct(slug.alias("slug"), F.lit(primary).alias("is_primary"), conf.alias("confidence"), evidence.alias("evidence"))

    conf = F.col("confidence")
    first = row(F.col("primary_category"), True, conf, F.col("matched"), 8)
    others = F.zip_with("secondary", "secondary_matched", lambda s, m: row(s, False, fixed(conf * 0.6, 3), m, 6))
    rows = decided.where("primary_category is not null").join(entities.select("id", "fingerprint"), "id")
    rows = rows.select(F.col("id").alias("entity_id"), F.explode(F.concat(F.array(first), others)).alias("r")).select("entity_id", "r.*")
    return rows if manual is None else rows.join(manual.select("entity_id", "slug"), ["entity_id", "slug"], "left_anti")


def attempted(entities: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """``entities`` with the watermark ``classified_on`` of those in ``ids(id)`` set, placed or not."""
    seen = ids.select("id", F.lit(True).alias("seen")).distinct()
    return entities.join(seen, "id", "left").withColumn("classified_on", F.when(F.col("seen"), now).otherwise(F.col("classified_on"))).drop("seen")


def filled_watermark(entities: DataFrame, assignment: DataFrame) -> DataFrame:
    """``entities`` with a null ``classified_on`` set to the last of their assignments."""
    last = assignment.groupBy(F.col("entity_id").alias("id")).agg(F.max("assigned_on").alias("last"))
    return entities.join(last, "id", "left").withColumn("classified_on", F.coalesce("classified_on", "last")).drop("last")


def statistics(entities: DataFrame, due: DataFrame, routed: DataFrame, written: DataFrame, manual: DataFrame) -> DataFrame:
    """One row: considered, cached, by rule, escalated, unclassified, written, manual_preserved."""
    state = entities.select("id").join(due.select("id", F.lit(True).alias("due")), "id", "left").join(routed.select("id", "route"), "id", "left")
    counts = state.agg(
        F.count("*").alias("considered"),
        F.count_if(F.col("due").isNull()).alias("cached"),
        F.count_if(F.col("due") & F.col("route").startswith("accept")).alias("by_rule"),
        F.count_if(F.col("due") & (F.col("route") == "escalate")).alias("escalated"),
        F.count_if(F.col("due") & (F.coalesce("route", F.lit("unclassified")) == "unclassified")).alias("unclassified"),
    )
    return counts.join(written.agg(F.count("*").alias("written"))).join(manual.agg(F.count("*").alias("manual_preserved")))  # one row each


def merge_external(labels: DataFrame) -> DataFrame:
    """Labels made elsewhere: confidence cut to 0..1 (not finite: 0.5), unrelated ones unclassified."""
    c = F.col("confidence")
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    fit = F.when(bad, 0.5).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)))
    return labels.select("id", F.when(F.col("related"), F.col("category")).alias("primary_category"), fit.alias("confidence"), F.slice("secondary", 1, 3).alias("secondary"))


def with_external(placed: DataFrame, labels: DataFrame, due: DataFrame, manual: DataFrame) -> DataFrame:
    """``placed`` assignments with those of entities that ``labels`` cover replaced by the labels.

    ``labels`` is ``(id, category, related, confidence, secondary)``; secondaries have 0.6 of the confidence, categories held
    by hand are left to it, and an unrelated label leaves the entity without one.
    """
    told = merge_external(labels)
    none = F.array().cast("array<string>")
    rows = told.withColumns({"matched": none, "secondary_matched": F.transform("secondary", lambda _: none)})
    made = expand(rows, due, manual).withColumn("source", F.lit("external")).dropDuplicates(["entity_id", "slug"])
    kept = placed.join(labels.select(F.col("id").alias("entity_id")), "entity_id", "left_anti")
    return kept.unionByName(made.select(*kept.columns))


def rule_faults(rules: DataFrame, category: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """Rules that no classification should run with: blank terms, one slug under two ordinals.

    With ``category(slug, group_slug)`` and ``groups(group_slug)`` also rules of no category, slugs that come twice, and
    categories of no group.
    """
    blank = rules.where(F.trim("term") == "").select("category", F.lit("blank term").alias("fault"))
    twice = rules.groupBy("category").agg(F.countDistinct("ordinal").alias("n")).where("n > 1").select("category", F.lit("two ordinals").alias("fault"))
    out = blank.unionByName(twice)
    if category is not None:
        strange = rules.select("category").distinct().join(category.select(F.col("slug").alias("category")), "category", "left_anti")
        repeated = category.groupBy(F.col("slug").alias("category")).agg(F.count("*").alias("n")).where("n > 1")
        out = out.unionByName(strange.withColumn("fault", F.lit("no such category"))).unionByName(repeated.select("category", F.lit("slug comes twice").alias("fault")))
    if category is not None and groups is not None:
        lost = category.join(groups, "group_slug", "left_anti").select(F.col("slug").alias("category"), F.lit("no such group").alias("fault"))
        out = out.unionByName(lost)
    return out
