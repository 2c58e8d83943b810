"""Full text search over stored postings: stems, stop words, phrases, ``or`` and minus.

Postings are a table of (term, id) with the term's greatest weight and its positions, dealt into buckets by term. A search
reads the buckets of its own terms only, groups them by entity once and decides the whole query on that one row;
a changed entity moves its own postings only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendlake.functions.text import tokens
from trendlake.operators.listing import WEIGHTS
from trendlake.versions import BUCKET, Tables

#: Words too common to be looked for.
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
#: Positions of one field; a phrase never reaches from one field into the next.
FIELD = 10_000_000
_CLAUSE = re.compile(r'-?"[^"]*"?|\S+')
KEYS = ["term", "id"]


def stem(word: Column) -> Column:
    """A word without the endings of plurals, -ing and -ed, so that its forms meet."""
    one = (
        F.when(word.rlike("[^aeiou]ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("(ss|x|ch|sh|zz)es$"), F.regexp_replace(word, "es$", ""))
        .when(word.rlike("[a-z][^sui]s$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )
    bare = F.regexp_replace(one, "(ing|ed)$", "")
    return F.when(one.rlike("[aeiouy].*[a-z](ing|ed)$") & bare.rlike("[aeiouy]") & (F.length(bare) > 2), F.regexp_replace(bare, r"([bdfgmnprt])\1$", "$1")).otherwise(one)


def terms(text: Column) -> Column:
    """(term, position) of every word that is looked for; stop words keep their place."""
    placed = F.transform(tokens(text), lambda t, i: F.struct(stem(t).alias("term"), i.alias("position"), t.alias("word")))
    return F.filter(placed, lambda p: ~p["word"].isin(*STOP_WORDS))


def postings(entities: DataFrame) -> DataFrame:
    """term, id, weight and positions of the names, descriptions and topics."""

    def placed(place: int, weight: float):
        return lambda t: F.struct(t["term"].alias("term"), (t["position"] + place * FIELD).alias("position"), F.lit(weight).alias("weight"))

    parts = []
    for place, (field, weight) in enumerate(WEIGHTS.items()):
        if field in entities.columns:
            value = F.array_join(field, " ") if dict(entities.dtypes)[field].startswith("array") else F.translate(F.col(field), "/", " ")
            parts.append(F.transform(terms(value), placed(place, weight)))
    flat = entities.select("id", F.explode(F.concat(*parts)).alias("t")).select("id", "t.*")
    return flat.groupBy("term", "id").agg(F.max("weight").alias("weight"), F.sort_array(F.collect_list("position")).alias("positions"))


def refresh(tables: Tables, run: str, before: DataFrame, after: DataFrame) -> None:
    """Bring the table ``posting`` in step with entities that changed from ``before`` to ``after``."""
    old, new = postings(before), postings(after)
    tables.change(run, "posting", {"posting": new}, {"posting": old.select(*KEYS).join(new.select(*KEYS), KEYS, "left_anti")})


def parsed(spark: SparkSession, q: str) -> list[list[tuple[bool, list[tuple[str, int]]]]]:
    """Alternatives of clauses (excluded, its terms by place): quotes make a phrase, ``or`` alternatives, a leading minus excludes."""
    flat, group = [], 0
    for n, word in enumerate(_CLAUSE.findall(q)):
        if word.lower() == "or":
            group += 1
        else:
            flat.append((group, n, word.startswith("-"), word.lstrip("-")))
    if not flat:
        return []
    rows = spark.createDataFrame(flat, "g int, n int, minus boolean, text string").select("g", "n", "minus", terms(F.col("text")).alias("terms")).collect()
    out: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: r["n"]):
        if r["terms"]:
            out.setdefault(r["g"], []).append((r["minus"], [(t["term"], t["position"]) for t in r["terms"]]))
    return list(out.values())


def search(tables: Tables, q: str, entities: DataFrame | None = None) -> DataFrame:
    """id and text_rank of the entities that the query matches, by the postings of its terms.

    The rank is the sum of the weights of the terms asked for. ``entities(id)`` is read only where an alternative
    excludes without asking for anything; a query of stop words alone matches nothing.
    """
    spark, groups = tables.spark, parsed(tables.spark, q)
    wanted = sorted({t for g in groups for _, c in g for t, _ in c})
    asked = sorted({t for g in groups for minus, c in g for t, _ in c if not minus})
    if not wanted:
        return spark.createDataFrame([], "id long, text_rank double")
    entry = tables.manifest()["tables"]["posting"]
    named = tables._dealt(spark.createDataFrame([(t,) for t in wanted], "term string"), entry).select(BUCKET).distinct().collect()
    hits = tables.read("posting", only={BUCKET: [str(r[0]) for r in named]}).where(F.col("term").isin(wanted))
    row = hits.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", F.struct("weight", "positions")))).alias("own"))
    bare = any(all(minus for minus, _ in g) for g in groups)
    if bare and entities is not None:
        row = entities.select("id").join(row, "id", "left")
    own = F.coalesce(F.col("own"), F.create_map().cast("map<string,struct<weight:double,positions:array<int>>>"))

    def holds(clause: list[tuple[str, int]]) -> Column:
        test = F.lit(True)
        for t, _ in clause:
            test = test & F.map_contains_key(own, t)
        (first, at), *rest = clause
        if rest:

            def follows(p: Column) -> Column:
                out = F.lit(True)
                for t, place in rest:
                    out = out & F.array_contains(own[t]["positions"], p + (place - at))
                return out

            test = test & F.coalesce(F.exists(own[first]["positions"], follows), F.lit(False))
        return test

    match = F.lit(False)
    for g in groups:
        every = F.lit(True)
        for minus, clause in g:
            every = every & (~holds(clause) if minus else holds(clause))
        match = match | every
    rank = F.lit(0.0)
    for t in asked:
        rank = rank + F.coalesce(own[t]["weight"], F.lit(0.0))
    return row.where(match).select("id", rank.alias("text_rank"))
