"""Text columns: references, dates, phrases, fingerprints, locations and search tokens."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST = "github.com"
# Forms of a reference and of its parts, edges of a phrase, and what a location is read without.
SSH = rf"(?i)^(?:git\+)?(?:ssh://)?git@{re.escape(HOST)}[:/](.+)$"
OWNER = r"^[A-Za-z0-9](?:[A-Za-z0-9]|-(?=[A-Za-z0-9])){0,38}$"
NAME = r"^[A-Za-z0-9][A-Za-z0-9._-]{0,99}$"
LONGEST = 300
BEFORE_PHRASE, WITHIN_PHRASE, AFTER_PHRASE = r"(?<![a-z0-9])", r"[\\s\\-_]+", r"(?![a-z0-9])"
PICTOGRAPHS = "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}\\x{200D}]"
MARKS = r"[()\[\]{}\"'`*_~]"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_date(text: Column) -> Column:
    """A timestamp, or null for anything that is not one."""
    return F.try_to_timestamp(text)


def phrase_pattern_column(phrase: Column) -> Column:
    """Patterns that match a phrase which no Latin letter or digit touches; blanks, hyphens and underscores are one, and case does not count."""
    escaped = F.regexp_replace(F.lower(phrase), r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("(?iu)" + BEFORE_PHRASE), F.regexp_replace(escaped, r"[\s\-]+", WITHIN_PHRASE), F.lit(AFTER_PHRASE))


def fingerprint(name: Column, description: Column, topics: Column, language: Column, readme: Column) -> Column:
    """A short digest of all that classification reads; the order of topics does not count."""
    empty = F.lit("")
    parts = F.struct(
        F.coalesce(name, empty).alias("n"),
        F.coalesce(description, empty).alias("d"),
        F.array_sort(F.coalesce(topics, F.array().cast("array<string>"))).alias("t"),
        F.coalesce(language, empty).alias("l"),
        F.substring(F.coalesce(readme, empty), 1, 4000).alias("r"),
    )
    return F.concat(F.lit("fp:"), F.substring(F.sha1(F.to_json(parts)), 1, 16))


def topic_set(topics: Column) -> Column:
    return F.array_distinct(F.transform(F.coalesce(topics, F.array().cast("array<string>")), lambda t: F.lower(trimmed(t))))


def seed_label(seed: Column) -> Column:
    """``phrase:x`` for seeds written ``q:x``, else ``topic:x``."""
    return F.when(seed.startswith("q:"), F.concat(F.lit("phrase:"), F.substring(seed, 3, 1_000_000))).otherwise(F.concat(F.lit("topic:"), seed))


def escape_like(text: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", text)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def reference(raw: Column) -> Column:
    """Struct ok, owner, name, full_name, url, error for whatever may name a repository."""
    return bound(trimmed(F.coalesce(raw, F.lit(""))), lambda text: bound(_shape(text), lambda s: bound(_parts(text, s), lambda p: _reference(text, s, p))))


def _shape(text: Column) -> Column:
    return F.struct(
        F.regexp_extract(text, SSH, 1).alias("ssh"), F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)).alias("scheme"),
        text.rlike(rf"(?i)^(?:www\.)?{re.escape(HOST)}/").alias("hosted"), F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://", "").alias("address"),
    )


def _parts(text: Column, s: Column) -> Column:
    host = F.regexp_replace(F.lower(F.regexp_extract(s["address"], r"^(?:[^/@]*@)?([^/:?#]*)", 1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(s["address"], r"^[^/?#]*", ""), r"[?#].*$", "")
    is_url = (s["scheme"] != "") | s["hosted"]
    where = F.when(s["ssh"] != "", s["ssh"]).when(is_url, path).otherwise(text)
    return F.struct(host.alias("host"), is_url.alias("is_url"), F.filter(F.split(where, "/"), lambda p: p != "").alias("parts"))


def _reference(text: Column, s: Column, p: Column) -> Column:
    parts, is_url = p["parts"], p["is_url"]
    owner = F.get(parts, F.lit(0))
    name = F.regexp_replace(F.get(parts, F.lit(1)), r"(?i)\.git$", "")
    error = (
        F.when(text == "", "empty reference")
        .when(F.length(text) > LONGEST, "reference too long")
        .when((s["ssh"] == "") & (s["scheme"] != "") & ~s["scheme"].isin("http", "https", "git"), "scheme not supported")
        .when((s["ssh"] == "") & is_url & (p["host"] != HOST), "host not supported")
        .when((s["ssh"] == "") & ~is_url & text.rlike(r"[:\\]|^//"), "not a reference")
        .when(F.size(parts) > 2, "page inside a repository")
        .when(F.size(parts) < 2, "owner or name missing")
        .when(~owner.rlike(OWNER), "bad owner")
        .when(~name.rlike(NAME), "bad name")
    )

    def given(e: Column) -> Column:
        ok, own, named = e["error"].isNull(), e["owner"], e["name"]
        full = F.concat(own, F.lit("/"), named)
        return F.struct(
            ok.alias("ok"), F.when(ok, own).alias("owner"), F.when(ok, named).alias("name"), F.when(ok, full).alias("full_name"),
            F.when(ok, F.concat(F.lit(f"https://{HOST}/"), full)).alias("url"), e["error"].alias("error"),
        )

    return bound(F.struct(owner.alias("owner"), name.alias("name"), error.alias("error")), given)


def flag_code(text: Column) -> Column:
    """Two-letter code of the first flag (a pair of regional indicators), or null."""
    pair = F.regexp_extract(text, "([\\x{1F1E6}-\\x{1F1FF}]{2})", 1)
    indicators = "".join(chr(0x1F1E6 + k) for k in range(26))
    return F.nullif(F.translate(pair, indicators, "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def plain_location(text: Column) -> Column:
    """Without pictographs, brackets and quotes, blanks collapsed."""
    out = F.regexp_replace(text, PICTOGRAPHS, " ")
    out = F.regexp_replace(out, MARKS, " ")
    return trimmed(F.regexp_replace(out, r"\s+", " "))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")
