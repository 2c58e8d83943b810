"""Language identification by Bayesian fusion of evidence.

For every row: tempered likelihoods of its text under byte-gram models of the languages and of
"no known language" (``und``), likelihoods of the declared language (markup or metadata), of the
address suffix and of the path code, and a prior of its host. Host priors are smoothed step by
step: a host's counts towards its domain's, those towards the whole corpus. All counts are expected
languages under the text alone, summed over every row; a row's own share is left out of its
host's prior.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendlake.llm.common import KEY, ROW, byte_values, column, frugal, lookup, portions, slices, unpack, with_fields, with_row_key
from trendlake.storage import materialize

LANGUAGES = ("en", "de", "fr", "es")
UNKNOWN = "und"
CLASSES = (*LANGUAGES, UNKNOWN)
#: Labelled documents a language that its byte-gram model is fitted on (the only bounded sample).
SAMPLE = 400
BUCKETS = 1 << 16
#: Neighbouring grams depend on each other, so each counts for this share of an observation.
TEMPER = 0.2
#: Weight of the uniform part in a language's model; what ``und`` has of the uniform chance of a gram.
FLOOR, UNKNOWN_ODDS = 0.1, 0.25
#: Rows that a level's parent counts for.
STRENGTH = 8.0
#: A row keeps its language from this posterior on.
ACCEPT = 0.5
#: Kinds of evidence beside the text and the host.
EVIDENCE = ("declared", "suffix", "code")
_OPENER = re.compile(rb"<!--|<(script|style)\b")
_FACTORS = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


def _grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 4-byte grams, text after text, and how many each text has."""
    parts = [b"\n%b\n" % t.lower() if t else b"" for t in texts]
    n = np.array([max(0, len(p) - 3) for p in parts])
    x = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    if len(x) < 4:
        return np.zeros(0, np.int64), n
    h = x[:-3] * _FACTORS[0] + x[1:-2] * _FACTORS[1] + x[2:-1] * _FACTORS[2] + x[3:] * _FACTORS[3]
    h = (h >> np.uint32(16)).astype(np.int64)
    ends = np.cumsum([len(p) for p in parts])
    inside = np.ones(len(x), bool)
    for back in (1, 2, 3):
        at = ends - back
        inside[at[at >= 0]] = False
    return h[inside[: len(h)]], n


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for lang in set(langs):
            texts = [t for t, x in zip(byte_values(batch.column(1)), langs, strict=True) if x == lang]
            for lo, hi in slices(texts, 1_000_000):
                totals[lang] = totals.get(lang, 0) + np.bincount(_grams(texts[lo:hi])[0], minlength=BUCKETS)
    for lang, counts in totals.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(counts[at])], ["lang", "gram", "n"])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> np.ndarray:
    """Log likelihoods (gram bucket x class) from ``sample`` documents labelled with each language.

    The sample is the ids with the lowest hashes, one row each however often an id is
    repeated; rows without an id or text train nothing. ``und`` has a fixed
    share of the uniform chance, so only texts that no model explains fall to it.
    """
    code = F.lower(F.substring_index(column(lang).cast("string"), "-", 1))
    chosen = docs.select(column(key).alias("id"), code.alias("lang"), column(text).cast("string").alias("text"))
    first = [
        chosen.where(F.col("lang") == x).select("id").where("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
        for x in LANGUAGES
    ]
    ids = sorted({r[0] for r in reduce(DataFrame.unionByName, first).collect()})
    rows = chosen.where(F.col("id").isin(ids) & F.col("lang").isin(*LANGUAGES) & F.col("text").isNotNull())
    # a bounded sample: few tasks, so that each gram is counted in few of them
    rows = rows.groupBy("lang", "id").agg(F.min("text").alias("text")).select("lang", "text").coalesce(len(LANGUAGES))
    counts = rows.mapInArrow(frugal(_count_batches), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    table = np.zeros((BUCKETS, len(CLASSES)))
    for r in counts.collect():  # at most BUCKETS rows a language
        table[r["gram"], CLASSES.index(r["lang"])] = r["n"]
    total = table.sum(axis=0)
    uniform = 1 / BUCKETS
    table = np.log((1 - FLOOR) * table / np.maximum(total, 1) + np.where(total > 0, FLOOR, 1) * uniform)
    table[:, CLASSES.index(UNKNOWN)] = np.log(UNKNOWN_ODDS * uniform)
    table[:, :-1][:, total[:-1] == 0] = np.log(0.5 * UNKNOWN_ODDS * uniform)  # without a model, less likely than und
    return table.astype(np.float32)


def without_tags(page: bytes) -> bytes:
    """``page`` with comments, scripts, styles and tags blanked, in one pass whatever is left open.

    What is never closed is text: a ``<`` behind the last ``>``, or the inside of an open comment.
    """
    low, last = page.lower(), page.rfind(b">")
    out, at, missing = [], 0, set()
    while 0 <= (begin := low.find(b"<", at)) <= last:
        opened = _OPENER.match(low, begin)
        closer = b"-->" if opened and opened[0] == b"<!--" else opened and b"</" + opened[1]
        end = -1
        if closer and closer not in missing:
            end = low.find(closer, begin + 1)
            if end < 0:
                missing.add(closer)
            else:
                end = low.find(b">", end)
        if end < 0:
            end = low.find(b">", begin)
        out.append(page[at:begin])
        at = end + 1
    return b" ".join([*out, page[at:]])


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32), pa.array(values.ravel()))


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _softmax(logs: np.ndarray) -> np.ndarray:
    weights = np.exp(logs - logs.max(axis=1, keepdims=True))
    return weights / weights.sum(axis=1, keepdims=True)


def _score_batches(handle, temper: float):
    """Replaces the columns text and html, the last two, by likelihood and share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = np.ascontiguousarray(handle.value.T)
        for batch in portions(batches):
            raws = byte_values(batch.column("text"))
            html = batch.column("html").to_pylist()
            texts = [without_tags(t) if t and m else t for t, m in zip(raws, html, strict=True)]
            out = np.zeros((len(texts), len(CLASSES)))
            for lo, hi in slices(texts, 250_000):
                h, n = _grams(texts[lo:hi])
                some = np.flatnonzero(n)
                if not len(some):
                    continue
                begin = (np.cumsum(n) - n)[some]
                for c in range(len(CLASSES)):
                    out[lo + some, c] = np.add.reduceat(columns[c].take(h).astype(np.float64), begin)
            out *= temper
            names = batch.schema.names[:-2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], _lists(out), _lists(_softmax(out))], [*names, "likelihood", "share"])

    return run


def _fuse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of all evidence: the prior of the host without the row's own share, and the likelihoods."""
    for batch in batches:
        share, above = _matrix(batch, "share"), _matrix(batch, "above")
        others = np.maximum(_matrix(batch, "of_host") - share, 0)
        prior = (others + STRENGTH * above) / (others.sum(axis=1, keepdims=True) + STRENGTH)
        logs = np.log(prior + 1e-9) + _matrix(batch, "likelihood")
        for name in EVIDENCE:
            logs += _matrix(batch, f"of_{name}")
        posterior = _softmax(logs)
        best = posterior.argmax(axis=1)
        top = posterior.max(axis=1)
        accepted = (best != CLASSES.index(UNKNOWN)) & (top >= ACCEPT)
        langs = pa.array(np.array(CLASSES, object)[best], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(ROW), langs, pa.array(top), pa.array(accepted)], [ROW, "lang", "posterior", "accepted"])


def host_parts(url: Column) -> dict[str, Column]:
    """Host, domain, two-letter country suffix or 'generic', and two-letter path code or 'none'."""
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]+)", 1))
    tld = F.substring_index(host, ".", -1)
    code = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1))
    return {
        "host": host,
        "domain": F.substring_index(host, ".", -2),
        "suffix": F.when(tld.rlike("^[a-z]{2}$"), tld).otherwise("generic"),
        "code": F.when(code != "", code).otherwise("none"),
    }


def _class_sums(df: DataFrame, keys: list[str]) -> DataFrame:
    """Expected rows in each class, and rows, of each key, summed map-side first."""
    sums = [F.sum(F.col("share")[k]).alias(f"c{k}") for k in range(len(CLASSES))]
    return df.groupBy(*keys).agg(*sums, F.sum("n").alias("n")).select(*keys, F.array(*[F.col(f"c{k}") for k in range(len(CLASSES))]).alias("sums"), "n")


def _smoothed(sums: Column, parent: Column, strength: float = STRENGTH) -> Column:
    total = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(sums, parent, lambda n, p: (n + F.lit(strength) * p) / (total + strength))


def identify(rows: DataFrame, model: np.ndarray, temper: float = TEMPER) -> DataFrame:
    """__tl_row, lang, posterior and accepted for each of ``rows(__tl_row, url, declared, text, html)``.

    ``__tl_row`` is handed through: every row gives one row, whatever it holds and however often.
    ``html`` marks texts whose tags are dropped first. Every kind of evidence may be null and then
    says nothing; a row without any text is ``und`` unless its other evidence is strong. Texts of any
    length are scored whole. Equal rows get equal results; an empty table gives an empty result.
    """
    spark = rows.sparkSession
    declared = F.nullif(F.regexp_extract(F.lower("declared"), r"^\s*([a-z]{2,3})(?:$|[^a-z])", 1), F.lit(""))
    narrow = rows.select(
        ROW,
        F.monotonically_increasing_id().alias("place"),
        *[c.alias(n) for n, c in host_parts(F.coalesce("url", F.lit(""))).items()],
        F.coalesce(declared, F.lit("none")).alias("declared"),
        F.lit(1).cast("long").alias("n"),
        F.col("text").cast("string").alias("text"),
        F.coalesce("html", F.lit(False)).alias("html"),
    )
    handle = spark.sparkContext.broadcast(model)
    kept = StructType(narrow.schema.fields[:-2])
    scored = narrow.mapInArrow(frugal(_score_batches(handle, temper)), with_fields(kept, "likelihood array<double>, share array<double>"))
    scored = materialize(scored, "evidence")

    hosts = materialize(_class_sums(scored, ["domain", "host"]), "hosts")
    as_share = hosts.withColumnRenamed("sums", "share")
    whole = _class_sums(as_share, []).first()
    n = int(whole["n"] or 0)
    totals = [float(x or 0) for x in whole["sums"]] if n else [0.0] * len(CLASSES)
    corpus = F.array(*[F.lit((x + STRENGTH / len(CLASSES)) / (n + STRENGTH)) for x in totals])
    domains = _class_sums(as_share, ["domain"]).select("domain", _smoothed(F.col("sums"), corpus).alias("above"), F.lit(1).alias("one"))
    hosts = hosts.join(domains, "domain").select("domain", "host", F.col("sums").alias("of_host"), "above", "n")

    def evidence(name: str) -> DataFrame:
        """log P(value | class) for at most some thousand values: codes of two or three letters."""
        sums = _class_sums(scored, [name])
        spread = F.col("n") / F.lit(float(max(n, 1)))
        logs = F.zip_with("sums", F.array(*[F.lit(t) for t in totals]), lambda x, t: F.log((x + STRENGTH * spread) / (t + STRENGTH)))
        return F.broadcast(sums.select(name, logs.alias(f"of_{name}")))

    out = lookup(scored, hosts, ["domain", "host"], F.xxhash64("place"), n)
    for name in EVIDENCE:
        out = out.join(evidence(name), name)
    out = out.select(ROW, "likelihood", "share", "of_host", "above", *[f"of_{name}" for name in EVIDENCE])
    return out.mapInArrow(frugal(_fuse_batches), with_fields(StructType([rows.schema[ROW]]), "lang string, posterior double, accepted boolean"))


def page_evidence(pages: DataFrame, row: Column) -> DataFrame:
    """A page's address and the ``lang`` of its ``html`` tag, however long that tag is."""
    inside = F.regexp_extract("html", r"(?i)<html\b([^>]*+)", 1)
    declared = F.regexp_extract(inside, r"(?i)\blang\s*=\s*[\"']?([A-Za-z-]{2,})", 1)
    return pages.select(row.alias(ROW), "url", declared.alias("declared"), F.col("html").alias("text"), F.lit(True).alias("html"))


def document_evidence(docs: DataFrame, row: Column, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """A document's source stands for its host, its ``lang`` for the declared language."""
    url, declared, content = (column(c).cast("string") for c in (source, lang, text))
    return docs.select(row.alias(ROW), url.alias("url"), declared.alias("declared"), content.alias("text"), F.lit(False).alias("html"))


def keep_known(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` without the rows in no known language; all columns and names stay as they are.

    Each row is judged on its own, so repeated rows stay or go together, and rows with a null id,
    language or source are judged by the rest. An empty or null text goes unless its language is declared
    and its source agrees. An empty table gives an empty result.
    """
    rows = with_row_key(docs)
    flat = rows.select(KEY, *[F.col(ROW)[c].alias(n) for n, c in (("text", text), ("lang", lang), ("source", source))])
    found = identify(document_evidence(flat, F.struct(KEY)), train(docs, key, text, lang))
    # written, so that its size is known: small, it is broadcast and no text is shuffled
    gone = materialize(found.where(~F.col("accepted")).select(F.col(ROW)[KEY].alias(KEY)), "gone")
    return rows.join(gone, KEY, "left_anti").select(*unpack(rows, docs.columns))
