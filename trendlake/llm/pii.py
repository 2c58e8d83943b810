"""Surrogates for personal data, in DataFrame functions alone.

Entities (mail addresses, phone numbers, payment cards, social security numbers, IPv4 addresses
and titled names) are found by one pattern, normalised and gathered over the whole corpus. Each
gets a replacement that a key, its kind and its normal form decide: the same everywhere, of the
same format, script and gender. Replacements that two entities share, or that are an entity of
the corpus themselves, are drawn again until none is left. They are then written into the texts.
Names are replaced word by word, also where a document repeats words of one without the title.
"""

from __future__ import annotations

from itertools import count as counter
from secrets import token_hex

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendlake.llm.common import KEY, ROW, lookup
from trendlake.storage import materialize, release

#: The Spark setting that holds the key. Without one a key is drawn for each call and forgotten.
KEY_SETTING = "spark.trendlake.pii.key"
#: Random draws before full formats are dealt out exactly. A format counts as full where it has at
#: most CROWDED values for each one in use (and SMALL beside), so going through it is linear.
ROUNDS, CROWDED, SMALL = 8, 16, 1024

# Titles with the gender they tell, or none; particles within names.
MALE = ("Mr", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Lady", "Madam", "Frau", "Fräulein", "Madame", "Mademoiselle", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Госпожа", "Κυρία")
NEUTRAL = ("Mx", "Dr", "Prof", "Professor")
PARTICLES = (
    "de", "da", "di", "do", "dos", "das", "del", "della", "der", "den", "des", "du", "la", "le", "las", "los", "van", "von", "vom",
    "zu", "zum", "zur", "ten", "ter", "af", "av", "bin", "bint", "ibn", "al", "el", "y", "e",
)
# Country codes of one and two digits; all others have three.
COUNTRY_CODES = (
    "1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56",
    "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98",
)
# Syllables and endings that names are made of, for each script.
SYLLABLES = {
    "latin": ["ba", "den", "fal", "go", "han", "jo", "ka", "lo", "mar", "ne", "pel", "ri", "sol", "ta", "vin", "wes"],
    "cyrillic": ["ба", "ве", "гор", "да", "зи", "ка", "ле", "мар", "но", "пе", "рос", "са", "ти", "фе", "хо", "ян"],
    "greek": ["βα", "γε", "δη", "θε", "κα", "λο", "μαρ", "νι", "πε", "ρο", "σα", "τι", "φι", "χρι", "ζω", "ξε"],
}
ENDINGS = {
    ("latin", "m"): ["o", "us", "an", "er"], ("latin", "f"): ["a", "ia", "ina", "elle"], ("latin", "s"): ["son", "er", "ez", "ot"],
    ("cyrillic", "m"): ["ий", "ан", "ор", "ей"], ("cyrillic", "f"): ["а", "ия", "ина", "ая"], ("cyrillic", "s"): ["енко", "ук", "их", "ман"],
    ("greek", "m"): ["ος", "ης", "ας", "ων"], ("greek", "f"): ["α", "η", "ια", "ινα"], ("greek", "s"): ["ίδη", "ου", "άκη", "ά"],
}
ENDINGS |= {(script, "n"): ENDINGS[script, "m"] + ENDINGS[script, "f"] for script in SYLLABLES}

_LETTER = r"[\p{L}\p{M}]"
#: Runs and loops are possessive, so that texts of any length are searched in linear time without a deep stack.
_EMAIL = r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.(?=[\p{L}\p{N}]))++\p{L}{2,}+"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_LOCAL_PHONE = r"(?<![0-9.-])[0-9]{3}([-.])[0-9]{3}\1[0-9]{4}(?![0-9]|[.-][0-9])"
_PHONE = rf"\+[0-9]{{1,3}}[ .-]?(?:\([0-9]{{2,4}}\)[ .-]?)?[0-9]{{2,4}}(?:[ .-]?[0-9]{{2,4}}){{1,4}}(?![0-9])|(?<![0-9])\([0-9]{{3}}\) ?[0-9]{{3}}-[0-9]{{4}}(?![0-9])|{_LOCAL_PHONE}"
_CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
_TITLES = rf"(?:(?:{'|'.join(MALE + FEMALE + NEUTRAL)})(?!{_LETTER})\.?[ \u00a0])++"
#: A word of a name: apostrophes inside belong to it, a genitive s behind it does not.
_WORD = rf"\p{{Lu}}{_LETTER}*+(?:['’](?!s(?!{_LETTER})){_LETTER}++)*+"
_MORE = rf"(?:(?:{'|'.join(PARTICLES)})[ \u00a0])*+(?!{_TITLES}){_WORD}"
_FIRSTS = "".join(sorted({title[0] for title in MALE + FEMALE + NEUTRAL}))
_NAME = rf"(?<!{_LETTER})(?=[{_FIRSTS}]){_TITLES}(?:\p{{Lu}}\.[ \u00a0]?(?=\p{{Lu}}))*+{_MORE}(?:[ \u00a0-]{_MORE})*+"
_OTHERS = rf"(?=[0-9+(])(?:{_IP}|{_SSN}|{_PHONE}|{_CARD})|{_NAME}"
#: One pattern for all kinds, the more specific ones first.
PATTERN = f"{_EMAIL}|{_OTHERS}"


#: A word that may be an untitled mention of a name.
_MENTION = rf"(?<!{_LETTER})(?<![\p{{N}}])(?=\p{{Lu}}(?:{_LETTER}|['’]{_LETTER})){_WORD}(?![\p{{N}}])"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, from the right."""
    n = F.length(digits)
    places = F.sequence(F.lit(1), n)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n + 1 - i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add)


def kind_of(raw: Column) -> Column:
    """email, ip, ssn, phone, card, name_m, name_f or name_n; null for digits that are no card number."""
    title = F.regexp_extract(raw, "^" + _TITLES, 0)

    def told(titles: tuple[str, ...]) -> Column:
        return title.rlike(rf"(?<!{_LETTER})(?:{'|'.join(titles)})(?!{_LETTER})")

    return (
        F.when(raw.contains("@"), "email")
        .when(raw.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(raw.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(raw.rlike(r"^[+(]|^[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}$"), "phone")
        .when(raw.rlike("^[0-9]"), F.when(_luhn(_digits(raw)) % 10 == 0, "card"))
        .when(told(FEMALE), "name_f")
        .when(told(MALE), "name_m")
        .otherwise("name_n")
    )


def _without_title(raw: Column) -> Column:
    return F.regexp_replace(raw, "^" + _TITLES, "")


def normal_form(raw: Column, kind: Column) -> Column:
    """What decides whether two spellings are one entity."""
    return (
        F.when(kind == "email", F.lower(raw))
        .when(kind == "phone", F.regexp_replace(raw, "[^0-9+]", ""))
        .when(kind.isin("card", "ssn"), _digits(raw))
        .when(kind == "ip", raw)
        .otherwise(_without_title(raw))
    )


def _seed(secret: str, *parts: Column) -> Column:
    return F.concat_ws("\u0001", F.lit(secret), *parts)


def _stream(secret: str, *parts: Column) -> Column:
    """A block of 32 keyed bytes, two hex digits each."""
    return F.sha2(F.concat_ws("\u0002", _seed(secret, *parts), F.lit("0")), 256)


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, i * 2 - 1, F.lit(2)), 16, 10).cast("int")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _redrawn(text: Column, seed: Column, keep: Column | int = 0) -> Column:
    """``text`` of any length with letters and digits behind the first ``keep`` characters drawn anew, 32 of them from each keyed block."""
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")

    def block(own: Column, k: Column) -> Column:
        def drawn(bytes_: Column) -> Column:
            def one(c: Column, i: Column) -> Column:
                b = _byte(bytes_, i + 1)
                new = F.when(c.rlike("[0-9]"), (b % 10).cast("string")).when(c.rlike(_LETTER), F.substring(letters, b % 26 + 1, F.lit(1)))
                return F.when(k * 32 + i < keep, c).otherwise(F.coalesce(new, c))

            return F.array_join(F.transform(F.split(F.substring(text, k * 32 + 1, F.lit(32)), ""), one), "")

        return _bound(F.sha2(F.concat_ws("\u0002", own, k.cast("string")), 256), drawn)

    blocks = F.sequence(F.lit(0), F.greatest(F.floor((F.length(text) - 1) / 32).cast("int"), F.lit(0)))
    return _bound(seed, lambda own: F.array_join(F.transform(blocks, lambda k: block(own, k)), ""))


def _word(secret: str, word: Column, role: Column, attempt: Column) -> Column:
    """A given name of gender ``m``, ``f`` or unknown ``n``, or a surname ``s``, in lower case, longer by a syllable with each attempt."""
    script = F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    stream = _stream(secret, F.lit("name"), role, word, attempt.cast("string"))
    syllables_drawn = F.least(attempt, F.lit(8)) + F.when(role == "s", 3).otherwise(2)

    def pick(table: list[str], b: Column) -> Column:
        return F.element_at(F.array(*[F.lit(x) for x in table]), b % len(table) + 1)

    def drawn_from(table: list[str]):
        return lambda i: pick(table, _byte(stream, i))

    out = None
    for s, syllables in SYLLABLES.items():
        body = F.array_join(F.transform(F.sequence(F.lit(1), syllables_drawn), drawn_from(syllables)), "")
        end = None
        for g in ("m", "f", "n", "s"):
            choice = pick(ENDINGS[s, g], _byte(stream, F.lit(20)))
            end = F.when(role == g, choice) if end is None else end.when(role == g, choice)
        whole = F.concat(body, end)
        out = F.when(script == s, whole) if out is None else out.when(script == s, whole)
    return out


def _kept(norm: Column) -> Column:
    """Leading characters of a phone number that a surrogate keeps: the country code and its plus sign."""
    known = F.substring(norm, 2, 2).isin(*[c for c in COUNTRY_CODES if len(c) == 2])
    short = F.substring(norm, 2, 1).isin(*[c for c in COUNTRY_CODES if len(c) == 1])
    return F.when(~norm.startswith("+"), 0).when(short, 2).when(known, 3).otherwise(4)


def surrogate(secret: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """The normal form of an entity's replacement at the given attempt; names come as their words."""
    drawn_by = (kind, norm, attempt.cast("string"))
    stream, seed = _stream(secret, *drawn_by), _seed(secret, *drawn_by)
    local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
    tld = F.substring_index(domain, ".", -1)
    body = F.substring(domain, F.lit(1), F.length(domain) - F.length(tld) - 1)
    by_domain = _seed(secret, F.lit("domain"), domain)
    email = F.concat(_redrawn(local, seed), F.lit("@"), _redrawn(body, by_domain), F.lit("."), tld)

    octets = F.split(norm, r"\.")
    drawn = [_byte(stream, F.lit(k)) for k in range(1, 5)]
    private = F.when(octets[0] == "10", 1).when((octets[0] == "192") & (octets[1] == "168"), 2).otherwise(0)
    first = F.when(private > 0, octets[0]).otherwise((drawn[0] % 100 + 11).cast("string"))
    second = F.when(private > 1, octets[1]).otherwise(drawn[1].cast("string"))
    ip = F.concat_ws(".", first, second, drawn[2].cast("string"), drawn[3].cast("string"))

    phone, redrawn = _redrawn(norm, seed, _kept(norm)), _redrawn(norm, seed, F.lit(1))
    head = F.substring(redrawn, F.lit(1), F.length(redrawn) - 1)
    check = (F.lit(10) - _luhn(F.concat(head, F.lit("0"))) % 10) % 10
    card = F.concat(head, check.cast("string"))
    ssn = F.concat(F.lit("9"), F.substring(_redrawn(norm, seed), F.lit(2), F.length(norm) - 1))  # area numbers from 900 are never given out
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind == "phone", phone)
        .when(kind == "ssn", ssn)
        .otherwise(_word(secret, norm, F.substring(kind, -1, 1), attempt))
    )


def written_like(raw: Column, kind: Column, new: Column) -> Column:
    """A replacement in the spelling of ``raw``: its separators, capitals and title."""
    digits = _digits(new)

    def laid(i: Column) -> Column:
        c = F.substring(raw, i, F.lit(1))
        nth = F.length(_digits(F.substring(raw, F.lit(1), i)))
        return F.when(c.rlike("[0-9]"), F.substring(digits, nth, F.lit(1))).otherwise(c)

    def cased(i: Column) -> Column:
        c, n = F.substring(raw, i, F.lit(1)), F.substring(new, i, F.lit(1))
        return F.when(c.rlike(r"\p{Lu}"), F.upper(n)).otherwise(n)

    def over(like: Column, one) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(like)), one), "")

    more = F.substring(digits, F.length(_digits(raw)) + 1, F.length(digits))  # of a widened format
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.concat(over(raw, laid), more))
        .when(kind == "email", over(new, cased))
        .when(kind == "ip", new)
        .otherwise(F.concat(F.regexp_extract(raw, "^" + _TITLES, 0), new))
    )


def widened(kind: Column, norm: Column, wide: Column) -> Column:
    """``norm`` in a format with more values: letters or digits more, or a larger range of addresses."""
    rest = F.substring_index(norm, ".", -3)
    ip = F.when((wide == 1) & norm.startswith("192.168."), F.concat(F.lit("10."), rest)).otherwise(F.concat(F.lit("11."), rest))
    email = F.concat(F.substring_index(norm, "@", 1), F.repeat(F.lit("a"), wide), F.lit("@"), F.substring_index(norm, "@", -1))
    wider = F.when(kind == "email", email).when(kind == "ip", ip).when(kind.isin("phone", "card", "ssn"), F.concat(norm, F.repeat(F.lit("0"), wide)))
    return F.when(wide > 0, F.coalesce(wider, norm)).otherwise(norm)


#: Places of a format: how many values each has.
_PLACES = {"\u0001": 26, "\u0002": 10, "\u0003": 1, "\u0004": 256, "\u0005": 100}


def _format(family: Column, new: Column) -> Column:
    """The format that a replacement was drawn in, as a template; null for words, which grow by themselves."""
    local = F.regexp_replace(F.regexp_replace(F.substring_index(new, "@", 1), "[a-z]", "\u0001"), "[0-9]", "\u0002")
    head, n = F.substring(new, 1, 1), F.length(new)
    ip = F.when(new.startswith("192.168."), "192.168.\u0004.\u0004").when(new.startswith("10."), "10.\u0004.\u0004.\u0004").otherwise("\u0005.\u0004.\u0004.\u0004")
    return (
        F.when(family == "email", F.concat(local, F.lit("@"), F.substring_index(new, "@", -1)))
        .when(family == "ip", ip)
        .when(family == "phone", F.concat(F.substring(new, F.lit(1), _kept(new)), F.repeat(F.lit("\u0002"), n - _kept(new))))
        .when(family == "ssn", F.concat(head, F.repeat(F.lit("\u0002"), n - 1)))
        .when(family == "card", F.concat(head, F.repeat(F.lit("\u0002"), n - 2), F.lit("\u0003")))
    )


def _radix(c: Column) -> Column:
    out = None
    for place, n in _PLACES.items():
        out = F.when(c == place, n) if out is None else out.when(c == place, n)
    return F.coalesce(out, F.lit(1)).cast("long")


def _nth(template: Column, i: Column) -> Column:
    """Value number ``i`` of a format."""

    def step(state: Column, c: Column) -> Column:
        r = F.pmod(state["rest"], _radix(c))
        piece = F.when(c == "\u0001", F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), r.cast("int") + 1, F.lit(1)))
        piece = piece.when(c.isin("\u0002", "\u0004"), r.cast("string")).when(c == "\u0005", (r + 11).cast("string")).when(c == "\u0003", "").otherwise(c)
        return F.struct(F.floor((state["rest"] - r) / _radix(c)).cast("long").alias("rest"), F.concat(state["out"], piece).alias("out"))

    start = F.struct(i.cast("long").alias("rest"), F.lit("").alias("out"))
    text = F.aggregate(F.split(template, ""), start, step)["out"]
    check = (F.lit(10) - _luhn(F.concat(text, F.lit("0"))) % 10) % 10
    return F.when(template.endswith("\u0003"), F.concat(text, check.cast("string"))).otherwise(text)


def _numbered(rows: DataFrame, order: Column, parts: int) -> DataFrame:
    """``number`` from 1 on within each (family, format), by ``order``; no task holds a whole format."""
    keys = ["family", "format"]
    dealt = materialize(rows.withColumn("__o", order).withColumn("__b", F.pmod(F.xxhash64("__o"), F.lit(parts))), "dealt")
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "__b").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy("__o"))
    return dealt.withColumn("__own", own).join(sizes, [*keys, "__b"]).withColumn("number", F.col("__own") + F.col("__before")).drop("__o", "__b", "__own", "__before", "__n")


def _dealt_out(state: DataFrame, real: DataFrame, secret: str, parts: int) -> DataFrame:
    """``state`` with the free values of full formats given to those that found none; the rest go to a wider format."""
    used = real.union(state.where("new is not null").select("family", "new")).withColumn("format", _format(F.col("family"), F.col("new")))
    losing = state.where("new is null").withColumn("format", _format(F.col("family"), F.col("tried")))
    full = used.groupBy("family", "format").agg(F.count("*").alias("n")).join(losing.select("family", "format").distinct(), ["family", "format"], "right")
    values = F.aggregate(F.split("format", ""), F.lit(1.0), lambda total, c: total * _radix(c))
    full = full.where("format is not null").withColumn("values", values)
    full = materialize(full.where(F.col("values") <= F.coalesce("n", F.lit(0)) * CROWDED + SMALL).select("family", "format", F.col("values").cast("long").alias("values")), "formats")
    blocks = full.withColumn("b", F.explode(F.sequence(F.lit(0), F.floor((F.col("values") - 1) / 4096)))).repartition(parts, F.xxhash64("format", "b"))
    each = F.explode(F.sequence(F.col("b") * 4096, F.least(F.col("values"), (F.col("b") + 1) * 4096) - 1))
    free = blocks.select("family", "format", each.alias("i")).select("family", "format", _nth(F.col("format"), F.col("i")).alias("new"))
    free = free.join(used.select("family", "new"), ["family", "new"], "left_anti")
    free = _numbered(free, F.sha2(F.concat_ws("\u0001", F.lit(secret), "new"), 256), parts)
    given = losing.join(full.select("family", "format"), ["family", "format"]).select("kind", "norm", "family", "format")
    given = _numbered(given, F.sha2(F.concat_ws("\u0001", F.lit(secret), "kind", "norm"), 256), parts)
    given = given.join(free, ["family", "format", "number"], "left").select("kind", "norm", F.col("new").alias("given"), F.lit(1).alias("dealt"))
    out = state.join(given, ["kind", "norm"], "left")
    wide = F.col("wide") + (F.col("dealt").isNotNull() & F.col("given").isNull()).cast("int")
    return materialize(out.select("kind", "norm", "family", "attempt", wide.alias("wide"), F.coalesce("new", "given").alias("new"), "tried"), "state")


def name_words(norm: Column, kind: Column) -> Column:
    """Structs (kind, norm, word, before) of a name's words.

    Words of the last part are surnames, word_s; the others are word_m, word_f or word_n. Initials
    have kind initial, and particles, which stay, none.
    """
    gender = F.concat(F.lit("word_"), F.substring(kind, -1, 1))
    parts = F.split(F.regexp_replace(norm, r"\.(?=\p{Lu})", ". "), "[ \u00a0]")

    def of_part(part: Column, k: Column) -> Column:
        own = F.when(k + 1 == F.size(parts), F.lit("word_s")).when(part.rlike(r"^\p{Ll}"), None).when(part.endswith("."), "initial").otherwise(gender)
        first = F.when(k == 0, F.lit("")).otherwise(F.lit(" "))

        def of_word(word: Column, j: Column) -> Column:
            return F.struct(own.alias("kind"), F.lower(word).alias("norm"), word.alias("word"), F.when(j == 0, first).otherwise(F.lit("-")).alias("before"))

        return F.transform(F.split(part, "-"), of_word)

    return F.flatten(F.transform(parts, of_part))


def _cased(new: Column, word: Column) -> Column:
    """A name word with the capitals of ``word``: all of them, or the first."""
    return F.when((F.length(word) > 1) & (F.upper(word) == word), F.upper(new)).otherwise(F.initcap(new))


def spellings(found: DataFrame) -> DataFrame:
    """raw, n, kind, norm for the spellings in ``found(raw)`` and how often they occur there."""
    raws = found.groupBy("raw").agg(F.count("*").alias("n")).withColumn("kind", kind_of(F.col("raw"))).where("kind is not null")
    return materialize(raws.withColumn("norm", normal_form(F.col("raw"), F.col("kind"))), "spellings")


def replacements(found: DataFrame, secret: str, draw=surrogate) -> DataFrame:
    """raw, kind, new for the distinct spellings in ``found(raw)``: no two entities share a replacement."""
    raws = spellings(found)
    return respelled(raws, assigned(raws, secret, draw), secret).select("raw", "kind", "new")


def respelled(raws: DataFrame, known: DataFrame, secret: str) -> DataFrame:
    """raw, n, kind, new and words for ``raws`` by the replacements of their entities.

    A name's replacement is that of its words, which are given too: kind, norm and new of each.
    """
    named = F.col("kind").startswith("name")
    words = raws.where(named).select("raw", F.posexplode(name_words(F.col("norm"), F.col("kind"))).alias("at", "w")).select("raw", "at", "w.*")
    counted = known.where("kind like 'word%'").join(words.groupBy("kind", "norm").agg(F.count("*").alias("n")), ["kind", "norm"])
    words = lookup(words, counted, ["kind", "norm"], F.xxhash64("raw"), raws.count(), how="left")
    letter = F.concat(F.upper(F.substring(_word(secret, F.col("norm"), F.lit("s"), F.lit(0)), 1, 1)), F.lit("."))
    words = words.withColumn("new", F.when(F.col("kind") == "initial", letter).otherwise(_cased(F.col("new"), F.col("word"))))
    one = F.struct("at", F.concat("before", F.coalesce("new", "word")).alias("new"), F.struct("kind", "norm", "new").alias("word"))
    built = words.groupBy("raw").agg(F.sort_array(F.collect_list(one)).alias("all"))
    built = built.select("raw", F.array_join("all.new", "").alias("new"), F.filter("all.word", lambda w: w["kind"].startswith("word")).alias("words"))
    columns = ["raw", "n", "kind", "norm", "new", "words"]
    names = raws.where(named).join(built, "raw").select(*columns)
    rest = raws.where(~named).join(known, ["kind", "norm"]).withColumn("words", F.lit(None).cast(names.schema["words"].dataType)).select(*columns)
    both = rest.unionByName(names)
    return both.select("raw", "n", "kind", written_like(F.col("raw"), F.col("kind"), F.col("new")).alias("new"), "words")


def assigned(raws: DataFrame, secret: str, draw=surrogate) -> DataFrame:
    """kind, norm, new for the entities in ``raws(kind, norm)``: no two share a replacement.

    Given names and surnames are entities of their own, so that a new draw moves every name with
    that word. The first draw of nearly all entities stands. Of entities that draw the same, the
    one of fewest attempts and smallest normal form keeps it; the others, and those that drew an
    entity of the corpus, draw again. After each ``ROUNDS`` draws the free values of full formats
    are dealt out, and an entity for which none is left goes on in a wider format.
    """
    named = F.col("kind").startswith("name")
    words = raws.where(named).select(F.explode(name_words(F.col("norm"), F.col("kind"))).alias("w")).where("w.kind like 'word%'")
    entities = raws.where(~named).select("kind", "norm").union(words.select("w.kind", "w.norm")).distinct()
    # drawing costs more than its few bytes show, so the partitions are counted out; by a hash of
    # its own, as the same columns again would be taken for the partitioning of distinct
    tasks = int(raws.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    state = entities.repartition(tasks, F.xxhash64("kind", "norm")).withColumn("family", F.substring_index("kind", "_", 1))
    none = F.lit(None).cast("string")
    state = materialize(state.withColumns({"attempt": F.lit(0), "wide": F.lit(0), "new": none, "tried": none}), "entities")
    real = state.select("family", F.col("norm").alias("new")).distinct()
    for round_ in counter(1):
        fresh = draw(secret, F.col("kind"), widened(F.col("kind"), F.col("norm"), F.col("wide")), F.col("attempt"))
        drawn = materialize(state.withColumn("new", F.coalesce("new", fresh)), "drawn")
        owner = drawn.groupBy("family", "new").agg(F.min(F.struct("attempt", "kind", "norm")).alias("owner"), F.count("*").alias("n"))
        clashes = owner.join(real.withColumn("taken", F.lit(True)), ["family", "new"], "left").where("n > 1 or taken")
        clashes = materialize(clashes.select("family", "new", "owner", F.coalesce("taken", F.lit(False)).alias("taken")), "clashes")
        if clashes.isEmpty():
            return drawn.select("kind", "norm", "new")
        mine = (F.col("owner.kind") == F.col("kind")) & (F.col("owner.norm") == F.col("norm"))
        again = F.col("owner").isNotNull() & (F.col("taken") | ~mine)
        following = drawn.join(clashes, ["family", "new"], "left").select(
            "kind", "norm", "family", (F.col("attempt") + again.cast("int")).alias("attempt"), "wide",
            F.when(~again, F.col("new")).alias("new"), F.when(again, F.col("new")).alias("tried"),
        )
        state = materialize(following, "state")
        release(drawn)
        if round_ % ROUNDS == 0:
            state = _dealt_out(state, real, secret, tasks)


def _scanned(rows: DataFrame, text: Column) -> DataFrame:
    every, others = (F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (PATTERN, _OTHERS))
    found = F.when(text.contains("@"), every).otherwise(others)
    return rows.withColumn("found", F.coalesce(found, F.array().cast("array<string>")))


def _marks(text: Column) -> dict[str, Column]:
    """parts and marks that make up ``text`` in turn.

    Marks are its entities and, where one of them is a name, all words that may mention one.
    """
    named = F.exists("found", lambda raw: F.coalesce(kind_of(raw).startswith("name"), F.lit(False)))
    gaps = F.split(text, PATTERN, -1)

    def words(gap: Column, k: Column) -> Column:
        inner = F.transform(F.regexp_extract_all(gap, F.lit(_MENTION), F.lit(0)), lambda w: F.struct(w.alias("raw"), F.lit(True).alias("mention")))
        entity = F.transform(F.slice("found", k + 1, F.lit(1)), lambda raw: F.struct(raw.alias("raw"), F.lit(False).alias("mention")))
        return F.concat(inner, entity)

    plain = F.transform("found", lambda raw: F.struct(raw.alias("raw"), F.lit(False).alias("mention")))
    return {
        "marks": F.when(named, F.flatten(F.transform(gaps, words))).otherwise(plain),
        "parts": F.when(named, F.flatten(F.transform(gaps, lambda gap: F.split(gap, _MENTION, -1)))).otherwise(gaps),
    }


def key_of(spark: SparkSession) -> str:
    """The key in the setting ``KEY_SETTING``, else a random one, which nobody can search originals by."""
    return spark.conf.get(KEY_SETTING, None) or token_hex(32)


def replace(docs: DataFrame, secret: str | None = None, text: str = "text", count: str = "n_chars") -> DataFrame:
    """``docs`` with every entity in its text replaced, ``count`` (if there) set anew, and ``n_entities``.

    Without ``secret`` the key is that of :func:`key_of`. A null or empty text, and one without entities,
    stays as it is; texts of any length are searched whole. Columns of the input keep their names,
    whatever these are, and order, and ``n_entities`` follows them. Repeated rows get equal texts; an
    empty table gives no rows. A digit run of card length that fails the Luhn check is no entity. Words of
    a titled name are replaced wherever the same document has them capitalised, and words side by side
    count once.
    """
    secret = secret or key_of(docs.sparkSession)
    rows = materialize(
        _scanned(docs.select(F.monotonically_increasing_id().alias(KEY), F.struct("*").alias(ROW)), F.col(ROW)[text]), "scanned"
    )
    hit = rows.where(F.size("found") > 0)
    raws = spellings(hit.select(F.explode("found").alias("raw")))
    total = raws.agg(F.sum("n")).first()[0] or 0
    known = materialize(respelled(raws, assigned(raws, secret), secret), "replacements")
    hit = hit.withColumns(_marks(F.col(ROW)[text]))
    places = hit.select(KEY, F.posexplode("marks").alias("at", "mark")).select(KEY, "at", "mark.raw", "mark.mention")
    found = lookup(places.where(~F.col("mention")), known, ["raw"], F.xxhash64(KEY, "at"), total, how="left")
    entities = found.select(KEY, "at", "raw", "mention", "new")
    # words of a document's names, with the role of their first mention
    names = found.where(F.col("kind").startswith("name")).select(KEY, "at", F.posexplode("words").alias("k", "w"))
    names = names.groupBy(KEY, F.col("w.norm").alias("norm")).agg(F.min_by("w.new", F.struct("at", "k")).alias("new"))
    mentions = places.where("mention").withColumn("norm", F.lower("raw")).join(names, [KEY, "norm"], "left")
    mentions = mentions.select(KEY, "at", "raw", "mention", _cased(F.lower("new"), F.col("raw")).alias("new"))
    places = entities.unionByName(mentions).withColumn("real", F.col("new").isNotNull()).withColumn("new", F.coalesce("new", "raw"))
    new = places.groupBy(KEY).agg(F.sort_array(F.collect_list(F.struct("at", "new", "real", "mention"))).alias("new"))
    joined = F.array_join(F.zip_with("parts", F.col("new.new"), lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")

    def counted(mark: Column, k: Column) -> Column:
        """A replaced mark is an entity, but for the further words of one untitled mention."""
        before = F.get("new", k - 1)
        further = mark["mention"] & before["mention"] & before["real"] & F.get("parts", k).isin(" ", "-")
        return mark["real"] & ~F.coalesce(further, F.lit(False))

    def columns(changed: bool) -> list[Column]:
        out = []
        for field in docs.schema.fields:
            value = F.col(ROW)[field.name]
            if changed and field.name == text:
                value = F.col("__changed")
            elif changed and field.name == count:
                value = F.length("__changed").cast(field.dataType)
            out.append(value.alias(field.name))
        return out

    done = hit.join(new, KEY).withColumns({"__changed": joined, "__entities": F.size(F.filter("new", counted)).cast("long")})
    done = done.select(*columns(True), F.col("__entities").alias("n_entities"))
    rest = rows.where(F.size("found") == 0).select(*columns(False), F.lit(0).cast("long").alias("n_entities"))
    return done.union(rest)


def stage(docs: DataFrame, secret: str | None = None) -> DataFrame:
    """:func:`replace` with the columns of ``docs`` alone."""
    out = replace(docs, secret)
    plain = [f"__c{k}" for k in range(len(docs.columns))]
    return out.toDF(*plain, "__tl_entities").select(*plain).toDF(*docs.columns)
