"""Score columns: trend, velocity, quality, licence class, grade and flags.

All are built-in expressions, so a scoring pass is one projection inside generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Licence identifiers by what they ask of an adopter.
PERMISSIVE = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Unlicense", "CC0-1.0", "0BSD", "MIT-0", "BSL-1.0", "Zlib", "PostgreSQL", "Python-2.0")
WEAK_COPYLEFT = ("MPL-2.0", "LGPL-2.1", "LGPL-3.0", "LGPL-2.1-only", "LGPL-3.0-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later", "EPL-2.0", "CDDL-1.0")
STRONG_COPYLEFT = ("GPL-2.0", "GPL-3.0", "GPL-2.0-only", "GPL-3.0-only", "GPL-2.0-or-later", "GPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later")
# Points of each quality dimension, of each licence class, and lowest score of each grade.
DIMENSIONS = {"maintenance": 26, "releases": 14, "community": 20, "responsiveness": 14, "documentation": 14, "licensing": 12}
LICENCE_VALUE = {"permissive": 1.0, "weak-copyleft": 0.8, "strong-copyleft": 0.55, "other": 0.35, "non-commercial": 0.15, "none": 0.0}
GRADES = ((80, "A"), (65, "B"), (50, "C"), (35, "D"))


def saturate(value: Column, middle: float) -> Column:
    """Rises from 0 towards 1, with a half at ``middle``."""
    return F.when(value <= 0, 0.0).otherwise(value / (value + F.lit(float(middle))))


def clamp(value: Column, low: Column | float, high: Column | float) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(F.greatest(value, as_column(low)), as_column(high))


def days_between(later: Column, earlier: Column) -> Column:
    """Days with fractions between two instants (dates count from midnight UTC)."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000.0)


def fixed(value: Column, digits: int) -> Column:
    """Rounded half up to ``digits``, the same in every engine."""
    return F.floor(value * F.lit(float(10**digits)) + 0.5) / F.lit(float(10**digits))


def steps(value: Column, bounds: Sequence[tuple[float, float]], beyond: float, strict: bool = False) -> Column:
    """The level of the first bound that ``value`` does not exceed (or, strict, the first it exceeds)."""
    out: Column | None = None
    for bound, level in bounds:
        test = value > bound if strict else value <= bound
        out = F.when(test, level) if out is None else out.when(test, level)
    return out.otherwise(beyond)


def trend(stars: Column, day: Column, week: Column, people_week: Column, released: Column, pushed: Column, created: Column, archived: Column, now: Column) -> Column:
    """Struct score, velocity and the components that make up the score."""
    floor0 = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0)).cast("double")
    day, week, people = floor0(day), floor0(week), floor0(people_week)
    age = days_between(now, created)
    release = F.when(released.isNull(), 0.0).otherwise(steps(days_between(now, released), ((7, 60.0), (30, 35.0), (90, 15.0), (180, 5.0)), 0.0))
    idle = F.when(pushed.isNull(), 0.0).otherwise(
        steps(days_between(now, pushed), ((365, 250.0), (180, 120.0), (90, 50.0), (30, 15.0)), 0.0, strict=True)
    )
    novelty = F.when((age <= 90) & (week > 0), week * (1 - age / 90) * 1.5).otherwise(0.0)
    score = F.greatest(day * 4 + week + people * 10 + release + novelty - idle, F.lit(0.0))
    active = ~F.coalesce(archived, F.lit(False))
    part = lambda c: F.when(active, c).otherwise(0.0)
    return F.struct(
        fixed(part(score), 2).alias("score"),
        fixed(part(week / F.greatest(stars - week, F.lit(50.0))), 5).alias("velocity"),
        part(day * 4).alias("daily"),
        part(week).alias("weekly"),
        part(people * 10).alias("contributors"),
        part(release).alias("release"),
        part(idle).alias("inactivity_penalty"),
        fixed(part(novelty), 2).alias("novelty_bonus"),
    )


def licence_class(spdx: Column) -> Column:
    """none, permissive, weak-copyleft, strong-copyleft, non-commercial or other."""
    name = F.regexp_replace(F.coalesce(spdx, F.lit("")), r"^\s+|\s+$", "")
    return (
        F.when(name == "", "none")
        .when(name == "NOASSERTION", "other")
        .when(name.isin(*PERMISSIVE), "permissive")
        .when(name.isin(*WEAK_COPYLEFT), "weak-copyleft")
        .when(name.isin(*STRONG_COPYLEFT), "strong-copyleft")
        .when(name.rlike("^CC-BY(-SA)?-"), "other")
        .when(name.rlike("NC|ND"), "non-commercial")
        .otherwise("other")
    )


def grade(score: Column) -> Column:
    """A to F; null for no score."""
    out = F.when(score.isNull(), None)
    for low, letter in GRADES:
        out = out.when(score >= low, letter)
    return out.otherwise("F")


def quality(c: dict[str, Column], now: Column) -> Column:
    """Struct score, grade, licence_class, the six dimensions and the ordered flags.

    ``c`` maps: stars, open_issues, contributors, share, pushed, released, releases_last_year,
    licence, readme_length, has_homepage, has_description, topics, archived, fork.
    """
    idle, since = days_between(now, c["pushed"]), days_between(now, c["released"])
    maintenance = F.when(c["pushed"].isNull(), 0.0).otherwise(steps(idle, ((7, 1.0), (30, 0.9), (90, 0.7), (180, 0.45), (365, 0.2)), 0.05))
    recency = steps(since, ((30, 1.0), (90, 0.85), (180, 0.6), (365, 0.35)), 0.15)
    cadence = saturate(F.coalesce(c["releases_last_year"], F.lit(1)), 4)
    releases = F.when(c["released"].isNull(), 0.25).otherwise(recency * 0.65 + cadence * 0.35)
    people = F.coalesce(c["contributors"], F.lit(0))
    known = c["share"].isNotNull() & (people > 0)
    spread = F.when(known, clamp(1 - (c["share"] - 0.4) / 0.55, 0.0, 1.0)).when(people == 1, 0.15).otherwise(0.5)
    community = saturate(people, 12) * 0.6 + spread * 0.4
    backlog = c["open_issues"] / F.greatest(c["stars"], F.lit(1))
    responsiveness = F.when(c["stars"] > 0, steps(backlog, ((0.01, 1.0), (0.03, 0.85), (0.06, 0.6), (0.12, 0.35)), 0.15)).otherwise(0.5)
    readme = F.coalesce(c["readme_length"], F.lit(0))
    documentation = saturate(readme, 3000)
    for has, more in ((c["has_homepage"], 0.15), (c["has_description"], 0.05), (F.coalesce(c["topics"], F.lit(0)) >= 3, 0.05)):
        documentation = F.when(has, F.least(documentation + more, F.lit(1.0))).otherwise(documentation)
    licence = licence_class(c["licence"])
    licensing = None
    for name, level in LICENCE_VALUE.items():
        licensing = F.when(licence == name, level) if licensing is None else licensing.when(licence == name, level)
    values = {
        "maintenance": maintenance, "releases": releases, "community": community,
        "responsiveness": responsiveness, "documentation": documentation, "licensing": licensing,
    }
    total: Column = F.lit(0.0)
    for name, points in DIMENSIONS.items():
        total = total + values[name] * points
    total = total * F.when(c["archived"], 0.35).otherwise(1.0) * F.when(c["fork"], 0.8).otherwise(1.0)
    score = F.floor(clamp(total, 0.0, 100.0) + 0.5).cast("int")
    flags = F.array_compact(
        F.array(
            F.when(idle > 365, "idle for more than a year").when(idle > 180, "idle for more than six months").when(c["pushed"].isNull(), "last commit unknown"),
            F.when(c["released"].isNull(), "never released").when(since > 365, "last release over a year old"),
            F.when(known & (c["share"] >= 0.9) & (people > 1), "one person does nearly all work").when(~known & (people == 1), "only one contributor"),
            F.when((c["stars"] > 0) & (backlog > 0.12) & (c["open_issues"] > 100), "many open issues for its audience"),
            F.when(readme < 500, "little or no readme"),
            F.when(licence == "none", "no licence: reuse is not allowed")
            .when(licence == "non-commercial", "licence limits commercial use")
            .when(licence == "strong-copyleft", "strong copyleft: derived work must be opened"),
            F.when(c["archived"], "archived and read-only"),
            F.when(c["fork"], "is a fork"),
        )
    )
    return F.struct(score.alias("score"), grade(score).alias("grade"), licence.alias("licence_class"), *[v.alias(k) for k, v in values.items()], flags.alias("flags"))
