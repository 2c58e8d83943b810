"""Nested payloads to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlake.functions.text import parse_date

ITEM = (
    "id:long,full_name:string,name:string,owner:struct<login:string>,description:string,homepage:string,language:string,"
    "stargazers_count:long,forks_count:long,open_issues_count:long,archived:boolean,fork:boolean,default_branch:string,"
    "topics:array<string>,license:struct<spdx_id:string>,created_at:string,pushed_at:string,updated_at:string"
)


def search_items(payloads: DataFrame, source: str, body: str = "body") -> DataFrame:
    """Items of search payloads as entity rows; missing counts are 0, flags false, the branch ``main``."""
    i = F.explode(F.from_json(body, f"items array<struct<{ITEM}>>")["items"])
    rows = payloads.select(i.alias("i"))
    zero, no = F.lit(0).cast("long"), F.lit(False)
    c = lambda n: F.col("i")[n]
    return rows.select(
        c("id").alias("github_id"), c("full_name").alias("full_name"),
        F.coalesce(c("owner")["login"], F.substring_index(c("full_name"), "/", 1)).alias("owner_login"),
        c("name").alias("name"), c("description").alias("description"), c("language").alias("language"),
        F.coalesce(c("stargazers_count"), zero).alias("stars"), F.coalesce(c("forks_count"), zero).alias("forks"),
        F.coalesce(c("open_issues_count"), zero).alias("open_issues"), F.coalesce(c("archived"), no).alias("is_archived"),
        F.coalesce(c("fork"), no).alias("is_fork"), F.coalesce(c("default_branch"), F.lit("main")).alias("default_branch"),
        F.coalesce(c("topics"), F.array().cast("array<string>")).alias("topics"), c("license")["spdx_id"].alias("license_spdx_id"),
        parse_date(c("created_at")).alias("created_at"), parse_date(F.coalesce(c("pushed_at"), c("updated_at"))).alias("pushed_at"),
        F.lit(source).alias("discovery_source"),
    )


def topic_names(nodes: Column) -> Column:
    """Names out of an array of topic nodes, null nodes dropped."""
    return F.filter(F.transform(nodes, lambda n: n["topic"]["name"]), lambda t: t.isNotNull())


def release_date(release: Column) -> Column:
    return parse_date(F.coalesce(release["publishedAt"], release["createdAt"]))


def pick_readme(candidates: list[Column]) -> Column:
    """The first candidate that is neither binary, null nor empty; each is a struct text, isBinary."""
    return F.coalesce(*[F.when(~F.coalesce(c["isBinary"], F.lit(False)) & (F.coalesce(c["text"], F.lit("")) != ""), c["text"]) for c in candidates])


def recent_releases(releases: Column, now: Column) -> Column:
    """Releases of the last 365 days that are no drafts; null for no list."""
    fresh = lambda r: ~F.coalesce(r["isDraft"], F.lit(False)) & (release_date(r) >= now - F.expr("interval 365 days"))
    return F.when(releases.isNotNull(), F.size(F.filter(releases, fresh)))


_NESTED = (
    "id string, databaseId long, nameWithOwner string, name string, description string, homepageUrl string, stargazerCount long, forkCount long, isArchived boolean, isFork boolean, "
    "owner struct<login:string,location:string>, primaryLanguage struct<name:string>, licenseInfo struct<spdxId:string>, issues struct<totalCount:long>, watchers struct<totalCount:long>, "
    "diskUsage long, defaultBranchRef struct<name:string>, repositoryTopics struct<nodes:array<struct<topic:struct<name:string>>>>, createdAt string, pushedAt string, "
    "latestRelease struct<tagName:string,publishedAt:string,createdAt:string>, releases struct<nodes:array<struct<isDraft:boolean,publishedAt:string,createdAt:string>>>, "
    "readmes array<struct<text:string,isBinary:boolean>>"
)


def nested(payloads: DataFrame, now: Column, body: str = "body", readmes: int = 7) -> DataFrame:
    """Entity rows out of nested payloads: topic names, the newest release, releases of a year, the first usable README."""
    rows = payloads.select(F.from_json(body, _NESTED).alias("i"))
    c = lambda path: F.col(f"i.{path}")
    zero = F.lit(0).cast("long")
    nodes = F.coalesce(c("repositoryTopics.nodes"), F.array().cast("array<struct<topic:struct<name:string>>>"))
    return rows.select(
        c("id").alias("node_id"), c("databaseId").alias("github_id"), c("nameWithOwner").alias("full_name"),
        F.coalesce(c("owner.login"), F.substring_index(c("nameWithOwner"), "/", 1)).alias("owner_login"), c("owner.location").alias("owner_location"),
        c("name").alias("name"), c("description").alias("description"), c("homepageUrl").alias("homepage"), c("primaryLanguage.name").alias("language"),
        topic_names(nodes).alias("topics"), c("licenseInfo.spdxId").alias("license_spdx_id"), c("stargazerCount").alias("stars"), c("forkCount").alias("forks"),
        F.coalesce(c("issues.totalCount"), zero).alias("open_issues"), F.coalesce(c("watchers.totalCount"), zero).alias("watchers"), F.coalesce(c("diskUsage"), zero).alias("size_kb"),
        c("defaultBranchRef.name").alias("default_branch"), c("isArchived").alias("is_archived"), c("isFork").alias("is_fork"),
        parse_date(c("createdAt")).alias("created_at"), parse_date(c("pushedAt")).alias("pushed_at"), c("latestRelease.tagName").alias("release_tag"),
        release_date(c("latestRelease")).alias("released_at"), recent_releases(c("releases.nodes"), now).alias("releases_last_year"),
        pick_readme([F.get(c("readmes"), F.lit(k)) for k in range(readmes)]).alias("readme"),
    )


def contributors(payloads: DataFrame, limit: int, body: str = "body", key: str = "entity_id") -> DataFrame:
    """Ranked people of each list; entries without a login are left out."""
    people = F.from_json(body, "array<struct<id:long,login:string,avatar_url:string,contributions:long,type:string>>")
    named = F.slice(F.filter(people, lambda p: F.coalesce(p["login"], F.lit("")) != ""), 1, limit)
    return payloads.select(key, F.posexplode(named).alias("at", "p")).select(key, (F.col("at") + 1).alias("rank"), "p.id", "p.login", F.coalesce("p.contributions", F.lit(0)).alias("contributions"))


def profiles(payloads: DataFrame, body: str = "body") -> DataFrame:
    p = F.from_json(body, "id long, login string, name string, company string, blog string, location string, followers long, public_repos long")
    rows = payloads.select(p.alias("p")).select("p.*")
    zero = F.lit(0).cast("long")
    return rows.withColumns({"blog": F.nullif(F.trim("blog"), F.lit("")), "followers": F.coalesce("followers", zero), "public_repos": F.coalesce("public_repos", zero)})
