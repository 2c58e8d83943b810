"""Benchmark decontamination with an FM-index for each shard of the training texts.

Words are runs of ``[a-z0-9]`` and non-ASCII characters after lower-casing A-Z. A window is
``WINDOW`` consecutive words of a benchmark item (a shorter item is one window). A shard is a
run of texts within a partition; no text leaves the task that reads it. A shard's index is
built over the numbers of the words that the benchmark uses. All other words are one separator,
and stretches shorter than the shortest window are left out: neither can hold a window.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from trendlake.llm.common import byte_values, column, frugal, portions, slices, with_fields
from trendlake.llm.fm_index import FMIndex
from trendlake.storage import materialize, release

WINDOW = 10
#: Bytes of text in one shard's index; bytes of benchmark text that are searched in one pass.
SHARD_BYTES, PASS_BYTES = 8_000_000, 16_000_000
#: Lower-case A-Z, keep 0-9, a-z and all bytes from 0x80, blank the rest.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class Windows:
    """The distinct windows of some benchmark items, as word numbers from 1."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW) -> None:
        self.numbers: dict[bytes, int] = {}
        self.items: list[str | None] = []
        owners: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for name, text in items:
            ids = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            if not ids:
                continue
            self.items.append(name)  # None: its windows are hits and no more
            size = min(window, len(ids))
            of_size = owners.setdefault(size, {})
            for s in range(len(ids) - size + 1):
                of_size.setdefault(tuple(ids[s : s + size]), set()).add(len(self.items) - 1)
        self.groups = []
        for size, of_size in owners.items():
            owned = [sorted(x) for x in of_size.values()]
            counts = np.array([len(x) for x in owned])
            flat = np.array([i for x in owned for i in x])
            self.groups.append((size, np.array(list(of_size)), counts, np.cumsum(counts) - counts, flat))
        self.shortest = min(owners, default=0)

    def scan(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text of a shard: its number of words, merged spans of hit words, item names."""
        pieces, sizes = [], np.zeros(len(texts), np.int64)
        get = self.numbers.get
        for k, text in enumerate(texts):
            words = words_of(text)
            sizes[k] = len(words)
            pieces.append(np.fromiter(map(get, words, repeat(0)), np.int32, len(words)))
            pieces.append(np.zeros(1, np.int32))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        names: list[set[int]] = [set() for _ in texts]
        if self.groups and texts:
            all_ = np.concatenate(pieces)
            first = np.cumsum(sizes + 1) - sizes - 1
            inside = np.diff(np.concatenate([[0], (all_ > 0).astype(np.int8), [0]]))
            begin, end = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
            fits = end - begin >= self.shortest
            begin, end = begin[fits], end[fits]
            if len(begin):
                n = end - begin + 1  # with the separator behind each stretch
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
                symbols = all_[at]
                symbols[np.cumsum(n) - 1] = 0
                self._find(symbols, at, first, spans, names)
        return [
            (int(sizes[k]), spans[k], [self.items[i] for i in sorted(names[k]) if self.items[i] is not None]) for k in range(len(texts))
        ]

    def _find(self, symbols, at, first, spans, names) -> None:
        index = FMIndex(symbols, len(self.numbers))
        change = np.zeros(len(symbols) + 1, np.int64)
        for size, patterns, counts, offsets, owners in self.groups:
            lo, hi = index.search(patterns)
            some = np.flatnonzero(hi > lo)
            if not len(some):
                continue
            n = (hi - lo)[some]
            pattern = np.repeat(some, n)
            found = index.locate(np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[some], n))
            np.add.at(change, found, 1)
            np.add.at(change, found + size, -1)
            doc = np.searchsorted(first, at[found], "right") - 1
            pairs = np.unique(np.stack([doc, pattern], axis=1), axis=0)
            for d, p in pairs.tolist():
                names[d].update(owners[offsets[p] : offsets[p] + counts[p]].tolist())
        hit = np.diff(np.concatenate([[0], (np.cumsum(change)[:-1] > 0).astype(np.int8), [0]]))
        begin, end = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
        doc = np.searchsorted(first, at[begin], "right") - 1
        for d, b, e in zip(doc.tolist(), at[begin].tolist(), (at[end - 1] + 1).tolist(), strict=True):
            spans[d].append((b - int(first[d]), e - int(first[d])))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words in ``spans`` (word numbers, ends exclusive)."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for b, e in spans:
        out.append(text[at : words[b][0]])
        at = words[e - 1][1]
    return "".join([*out, text[at:]])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((b, e))
    return out


def _passes(bench: DataFrame, item: str, text: str) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in blocks of bounded size, each small enough for driver and tasks."""
    chosen = bench.select(column(item).cast("string").alias("item"), column(text).cast("string").alias("text")).where("text is not null")
    total = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // PASS_BYTES))
    for k in range(blocks):
        block = chosen if blocks == 1 else chosen.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k)
        yield [(r[0], r[1].encode()) for r in block.collect()]


def _scan_batches(handle, at: int):
    """Adds n_words, spans and items to each batch, or extends those of an earlier pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = handle.value
        for batch in portions(batches, 2048):
            texts = byte_values(batch.column(0).flatten()[at])
            old = [c.to_pylist() for c in batch.columns[1:]]
            found = [x for lo, hi in slices(texts, SHARD_BYTES) for x in windows.scan(texts[lo:hi])]
            flat, items = [], []
            for k, (_, spans, names) in enumerate(found):
                if old and old[1][k]:
                    spans = merged(spans + list(zip(old[1][k][::2], old[1][k][1::2], strict=True)))
                flat.append([x for span in spans for x in span])
                items.append(sorted({*names, *(old[2][k] if old else ())}))
            columns = [
                pa.array([x[0] for x in found], pa.int64()),
                pa.array(flat, pa.list_(pa.int64())),
                pa.array(items, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc", "n_words", "spans", "items"])

    return run


def _search(docs: DataFrame, bench: DataFrame, text: str, item: str, bench_text: str, window: int):
    """The table, as struct ``doc``, that the last pass reads; that pass; the schema that it gives.

    The text is a string in ``doc``, whatever it was before.
    """
    whole = F.struct("*")
    if docs.schema[text].dataType != StringType():
        whole = F.struct(*[column(c).cast("string").alias(c) if c == text else column(c) for c in docs.columns])
    out = docs.select(whole.alias("doc"))
    schema = with_fields(out.schema, "n_words bigint, spans array<bigint>, items array<string>")
    handle = run = before = None
    for items in _passes(bench, item, bench_text):
        if run is not None:
            out = materialize(out.mapInArrow(frugal(run), schema), "searched")
            handle.unpersist()
            if before is not None:
                release(before)
            before = out
        handle = docs.sparkSession.sparkContext.broadcast(Windows(items, window))
        run = _scan_batches(handle, docs.columns.index(text))
    return out, run, schema


def scan(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", bench_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Struct ``doc`` (all columns), n_words, flat word spans and item names per row.

    Null or empty texts have no words, long ones are searched whole; benchmark rows with a null text
    are passed over, the windows of one with a null id are hits that no item is named for; an item whose
    words are all of an earlier item's is reported as well. Equal rows get equal results; an empty
    table gives no rows. A benchmark beyond ``PASS_BYTES`` is searched block by block: each pass adds to
    the spans of the last, which is written before, so no task holds more than one block's windows.
    """
    out, run, schema = _search(docs, bench, text, item, bench_text, window)
    return out.mapInArrow(frugal(run), schema)


def report(docs: DataFrame, bench: DataFrame, key: str = "doc_id", **names: str) -> DataFrame:
    """Per document the counts of its words, hit words and items, a digest and a verdict."""
    narrow = docs.select(column(key), column(names.get("text", "text")))
    found = scan(narrow, bench, **names)
    hit = F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.size("spans") - 2, F.lit(0)), F.lit(2)),
        F.lit(0).cast("long"),
        lambda a, k: a + F.coalesce(F.get("spans", k + 1) - F.get("spans", k), F.lit(0)),
    )
    return found.select(
        F.col("doc")[key].alias(key),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def _cut_batches(run, at: int, count: int | None):
    """The rows that ``run`` has searched, with their spans cut out; rows that are nothing else go."""

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            n_words, spans = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            rows = batch.column(0)
            dirty = [k for k, s in enumerate(spans) if s]
            fields = rows.flatten()
            if dirty:
                texts = fields[at].to_pylist()
                for k in dirty:
                    texts[k] = cut(texts[k], list(zip(spans[k][::2], spans[k][1::2], strict=True)))
                fields[at] = pa.array(texts, fields[at].type)
                if count is not None:
                    counts = fields[count].to_pylist()
                    for k in dirty:
                        counts[k] = len(texts[k])
                    fields[count] = pa.array(counts, fields[count].type)
            out = pa.RecordBatch.from_arrays(fields, [f.name for f in rows.type])
            gone = [s == [0, n] and n > 0 for s, n in zip(spans, n_words, strict=True)]
            yield out.filter(pa.array([not g for g in gone])) if any(gone) else out

    return cut_all


def remove(docs: DataFrame, bench: DataFrame, text: str = "text", count: str = "n_chars", **names: str) -> DataFrame:
    """``docs`` with every hit span cut out of its text and ``count`` (if there) set anew.

    A document that has no word left after a cut is dropped; all others stay, clean ones
    untouched, and so do null and empty texts. Repeated rows stay repeated, and an empty table gives no
    rows. Columns, whatever their names, and their order stay as they are.
    """
    names = {"item": "item_id", "bench_text": "text", "window": WINDOW} | names
    out, run, schema = _search(docs, bench, text, **names)
    at = docs.columns.index(text)
    counted = docs.columns.index(count) if count in docs.columns else None
    # searched and cut in one pass, so that each task has one worker and texts cross over once
    return out.mapInArrow(frugal(_cut_batches(run, at, counted)), schema["doc"].dataType)
