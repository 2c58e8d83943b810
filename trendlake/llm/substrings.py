"""Removal of repeated passages by suffix arrays over the whole corpus.

A byte goes where a string of ``SPAN`` bytes that covers it also starts in a document of a smaller id.
Sorting all suffixes of a corpus would move every text many times, so the arrays are built over what can repeat:

1. Documents are packed into blocks, a table bucketed by block that is never shuffled again. Of equal
   texts only the smallest id goes on; the others hold nothing that is not in it.
2. Every string of ``SPAN`` bytes has an anchor, the ``GRAM`` bytes in it with the smallest hash. Equal strings have equal
   anchors, so a string whose anchor is in no second document cannot repeat. Blocks send the hash of each anchor once to
   buckets, and buckets answer with a bit for each.
3. Strings of the anchors that are left go, but for those that a document of a smaller id in the block has too, joined where they overlap, to the shard of their anchor's hash. A shard is cut
   into parts; each part has its suffix array (Larsson-Sadakane), common prefixes (Kasai) and so its distinct
   strings in order with their smallest id; parts are merged by binary search. A shard that one anchor's many
   variants make too large is dealt into pieces, and every two pieces meet.
4. Blocks get back which bytes go.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendlake.llm.common import byte_values, column, frugal, lookup, portions
from trendlake.llm.groups import block_pairs, gather
from trendlake.llm.suffixes import SPAN, least_of
from trendlake.storage import materialize, release, scratch_path

GRAM = 20
#: Bytes of a block, of text a bucket of anchors and of a bucketed file, texts a part and a shard, texts in a row that is sent.
BLOCK_BYTES, BUCKET_BYTES, FILE_BYTES, PART_ROWS, SHARD_ROWS, SENT_ROWS = 4 << 20, 16 << 20, 64 << 20, 8_000, 32_000, 16_000
#: Places of a text worked on at a time: few enough for a processor's cache, and a place must fit the low bits of an anchor's hash.
SLICE = 1 << 16
_PLACE = np.uint64((1 << 24) - 1)
_FAR = np.int64(np.iinfo(np.int64).max)
#: A null id comes after all others.
NO_ID = int(_FAR)
_BASE = 0x9E3779B97F4A7C15
_BLOCK = "block long, ids array<long>, sizes array<long>, digests array<binary>, data binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, count = TaskContext.get().partitionId() << 33, 0
    ids: list[int] = []
    texts: list[bytes] = []
    size = 0

    def block() -> pa.RecordBatch:
        digests = [hashlib.sha256(t).digest() for t in texts]
        row = [[base + count], [list(ids)], [[len(t) for t in texts]], [digests], [b"".join(texts)]]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.binary()]
        ids.clear(), texts.clear()
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["block", "ids", "sizes", "digests", "data"])

    for part in portions(batches):
        for key, text in zip(part.column(0).to_pylist(), byte_values(part.column(1)), strict=True):
            text = text or b""
            if texts and size + len(text) > BLOCK_BYTES:
                yield block()
                count, size = count + 1, 0
            ids.append(key), texts.append(text)
            size += len(text)
    if texts:
        yield block()


def _rolled(data: np.ndarray, gram: int) -> np.ndarray:
    """A mixed 64-bit hash of the ``gram`` bytes at every place where so many are left."""
    h, have = data.astype(np.uint64) + np.uint64(1), 1
    out, taken = None, 0
    with np.errstate(over="ignore"):
        while True:
            if gram & have:
                if out is None:
                    out = h.copy()
                else:
                    n = len(data) - taken - have + 1
                    out = out[:n] * np.uint64(pow(_BASE, have, 1 << 64)) + h[taken : taken + n]
                taken += have
            if taken == gram:
                break
            h = h[:-have] * np.uint64(pow(_BASE, have, 1 << 64)) + h[have:]
            have *= 2
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return out


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Other hashes, one for one: those of anchors are the smallest of their neighbours, and would be dealt unevenly."""
    with np.errstate(over="ignore"):
        hashes = (hashes ^ (hashes >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        hashes ^= hashes >> np.uint64(31)
        hashes *= np.uint64(_BASE)
    return hashes ^ (hashes >> np.uint64(32))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    more = width - have
    return np.minimum(values[:-more], values[more:]) if more else values


def anchored(data: np.ndarray, sizes: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings with one anchor: hash, first place, number of strings, document.

    ``data`` holds the documents one behind the other; strings lie within a document.
    """
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    out = []
    for a in range(0, max(len(data) - span + 1, 0), SLICE):
        piece = data[a : a + SLICE + span - 1]
        hashes = _rolled(piece, gram)
        marked = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        place = (_least(marked, span - gram + 1) & _PLACE).astype(np.int64)
        doc = owner[a : a + len(place)]
        place[doc != owner[a + span - 1 : a + span - 1 + len(place)]] = -1  # reaches into the next document
        at = np.append(0, np.flatnonzero(place[1:] != place[:-1]) + 1)
        count = np.diff(np.append(at, len(place)))
        kept = place[at] >= 0
        at, count = at[kept], count[kept]
        out.append((_mixed(hashes[place[at]]), at + a, count, doc[at]))
    if not out:
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _dealt(hashes: np.ndarray, count: int) -> np.ndarray:
    """One of ``count`` ranges for each hash, in the order of the hashes."""
    return (((hashes >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int64)


class _Block:
    """One row of the block table, without the documents that are copies."""

    def __init__(self, row: dict, gram: int = GRAM):
        self.number, self.ids = row["block"], [NO_ID if k is None else k for k in row["ids"]]
        self.sizes, self.data = np.array(row["sizes"], np.int64), np.frombuffer(row["data"], np.uint8)
        self.copies = row.get("copies") or []

    def runs(self, span: int, gram: int):
        hashes, first, count, doc = anchored(self.data, self.sizes, span, gram)
        if self.copies:
            kept = ~np.isin(doc, self.copies)
            hashes, first, count, doc = hashes[kept], first[kept], count[kept], doc[kept]
        return hashes, first, count, doc

    def settled(self, hashes: np.ndarray, first: np.ndarray, count: np.ndarray, doc: np.ndarray, span: int, gram: int) -> np.ndarray:
        """Which runs a document of a smaller id in this very block has too, whole: they go, and need not be sent."""
        order = np.argsort(hashes)
        same = hashes[order][1:] == hashes[order][:-1]
        at = order[np.append(False, same) | np.append(same, False)] if len(order) else order
        sizes, out = count[at] + span - 1, np.zeros(len(hashes), bool)
        if len(at):
            ids = np.array(self.ids, np.int64)[doc[at]]
            kept, number = _distinct(_rows_of(self.data, first[at], sizes, 2 * span - gram), sizes)
            low = np.full(len(kept), _FAR)
            np.minimum.at(low, number, ids)
            out[at] = ids > low[number]
        return out


def _joined(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of all ranges one behind the other."""
    ends = np.cumsum(sizes)
    return data[np.arange(ends[-1]) - np.repeat(ends - sizes - first, sizes)]


def _rows_of(data: np.ndarray, first: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """A row of ``width`` bytes for each range, zeros behind it."""
    out = np.zeros((len(first), width), np.uint8)
    out[np.arange(width) < sizes[:, None]] = _joined(data, first, sizes)
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield from batch.slice(i, 1).to_pylist()


def _out(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in columns.values()], list(columns))


def _ask(buckets: int, span: int, gram: int):
    """Each block's distinct anchors by bucket, six bytes each, and whether two of its documents have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _Block(row)
            hashes, _, _, doc = block.runs(span, gram)
            order = np.argsort(hashes)
            hashes, doc = hashes[order], doc[order]
            if not len(hashes):
                continue
            begins = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
            many = np.minimum.reduceat(doc, begins) != np.maximum.reduceat(doc, begins)
            keys = hashes[begins]
            bucket = _dealt(keys, buckets)
            edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(keys))
            octets = np.ascontiguousarray(keys).view(np.uint8).reshape(-1, 8)[:, :6]
            parts = list(zip(edges[:-1], edges[1:], strict=True))
            yield _out({
                "bucket": ([int(bucket[a]) for a, _ in parts], pa.int32()), "block": ([block.number] * len(parts), pa.int64()),
                "keys": ([octets[a:b].tobytes() for a, b in parts], pa.binary()), "many": ([np.packbits(many[a:b]).tobytes() for a, b in parts], pa.binary()),
            })

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block a bit for each key it sent to a bucket: whether another document has it too."""

    def solved(rows: list[dict]) -> pa.RecordBatch:
        sizes = [len(r["keys"]) // 6 for r in rows]
        keys = np.zeros((sum(sizes), 8), np.uint8)
        keys[:, :6] = np.frombuffer(b"".join(r["keys"] for r in rows), np.uint8).reshape(-1, 6)
        flat = keys.view(np.uint64)[:, 0]
        many = np.concatenate([np.unpackbits(np.frombuffer(r["many"], np.uint8))[:n] for r, n in zip(rows, sizes, strict=True)]).astype(bool)
        order = np.argsort(flat)
        begins = np.flatnonzero(np.append(True, flat[order][1:] != flat[order][:-1]))
        shared = np.diff(np.append(begins, len(flat))) > 1
        hit = np.zeros(len(flat), bool)
        hit[order] = np.repeat(shared | np.logical_or.reduceat(many[order], begins), np.diff(np.append(begins, len(flat))))
        edges = np.cumsum([0, *sizes])
        bits = [np.packbits(hit[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        sums = [int(hit[a:b].sum()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return _out({"block": ([r["block"] for r in rows], pa.int64()), "bucket": ([r["bucket"] for r in rows], pa.int32()), "bits": (bits, pa.binary()), "hits": (sums, pa.int64())})

    held: list[dict] = []
    for row in _rows(batches):
        if held and held[-1]["bucket"] != row["bucket"]:
            yield solved(held)
            held = []
        held.append(row)
    if held:
        yield solved(held)


_SENT = "bucket int, shard int, block long, n int, ids binary, firsts binary, counts binary, text binary"


def _small(values: bytes) -> bytes:
    """Compressed, with the size in front; the strings of one shard share little, but each holds common words."""
    return len(values).to_bytes(8, "little") + pa.compress(values, "zstd", asbytes=True)


def _large(values: bytes) -> bytes:
    return pa.decompress(values[8:], int.from_bytes(values[:8], "little"), "zstd", asbytes=True)


def _send(buckets: int, each: int, span: int, gram: int):
    """The strings of each block's repeated anchors, joined where they overlap, by shard, of which each bucket has ``each``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _Block(row)
            hashes, first, count, doc = block.runs(span, gram)
            keys = np.unique(hashes)
            bucket = _dealt(keys, buckets)
            hit = np.zeros(len(keys), bool)
            for answer in row["answers"]:
                a, b = np.searchsorted(bucket, answer["bucket"]), np.searchsorted(bucket, answer["bucket"], "right")
                hit[a:b] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8))[: b - a]
            keep = hit[np.searchsorted(keys, hashes)] & ~block.settled(hashes, first, count, doc, span, gram)
            hashes, first, count, doc = hashes[keep], first[keep], count[keep], doc[keep]
            if not len(hashes):
                continue
            shard = _dealt(hashes, buckets * each)
            order = np.argsort(shard, kind="stable")
            shard, first, count, doc = shard[order], first[order], count[order], doc[order]
            ids = np.array(block.ids, np.int64)[doc]
            edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist()
            edges = sorted({*edges, *range(0, len(shard), SENT_ROWS), len(shard)})
            sizes = count + span - 1
            ends = np.cumsum(sizes)
            text = _joined(block.data, first, sizes)
            parts = list(zip(edges[:-1], edges[1:], strict=True))
            blob = lambda x: [_small(np.ascontiguousarray(x[a:b]).tobytes()) for a, b in parts]
            yield _out({
                "bucket": ([int(shard[a]) // each for a, _ in parts], pa.int32()), "shard": ([int(shard[a]) for a, _ in parts], pa.int32()), "block": ([block.number] * len(parts), pa.int64()), "n": ([b - a for a, b in parts], pa.int32()),
                "ids": (blob(ids), pa.binary()), "firsts": (blob(first), pa.binary()), "counts": (blob(count.astype(np.int16)), pa.binary()),
                "text": ([_small(text[ends[a] - sizes[a] : ends[b - 1]].tobytes()) for a, b in parts], pa.binary()),
            })

    return run


def _distinct(texts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal rows, and for each row the number of its set."""
    wide = np.pad(texts, ((0, 0), (0, -texts.shape[1] % 8)))
    with np.errstate(over="ignore"):
        code = sizes.astype(np.uint64)
        for k, word in enumerate(wide.view(np.uint64).T):
            code = (code ^ word) * np.uint64(pow(_BASE, k + 1, 1 << 64) | 1)
            code ^= code >> np.uint64(31)
    order = np.argsort(code, kind="stable")
    head = np.append(True, code[order][1:] != code[order][:-1])
    number = np.empty(len(texts), np.int64)
    number[order] = np.cumsum(head) - 1
    firsts = order[head]
    odd = np.flatnonzero((sizes != sizes[firsts[number]]) | (texts != texts[firsts[number]]).any(axis=1))  # equal codes of unequal rows
    number[odd] = len(firsts) + np.arange(len(odd))
    return np.append(firsts, odd), number


_SPANS = "block long, froms binary, tos binary"


def _remove(span: int, gram: int, part: int):
    """For each block the byte ranges that go, of its strings in one shard."""
    width = 2 * span - gram
    names = ["shard", "__i", "__j"]

    def solved(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        of = lambda name, kind: np.concatenate([np.frombuffer(_large(r[name]), kind) for r in rows])
        ids, firsts, counts = of("ids", np.int64), of("firsts", np.int64), of("counts", np.int16).astype(np.int64)
        sizes = counts + span - 1
        texts = np.zeros((len(ids), width), np.uint8)
        texts[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(_large(r["text"]) for r in rows), np.uint8)
        kept, number = _distinct(texts, sizes)
        low = np.full(len(kept), _FAR)
        np.minimum.at(low, number, ids)
        best = least_of(texts[kept], sizes[kept], low, part, span)
        edges = np.cumsum([0, *[r["n"] for r in rows]])
        for r, a, b in zip(rows, edges[:-1], edges[1:], strict=True):
            goes = np.zeros((b - a, best.shape[1] + 2), np.int8)
            goes[:, 1:-1] = best[number[a:b]] < ids[a:b, None]
            step = np.diff(goes, axis=1)
            at, begin = np.nonzero(step == 1)
            _, end = np.nonzero(step == -1)
            if len(at):
                begin, end = firsts[a:b][at] + begin, firsts[a:b][at] + end + span - 1
                joined = np.append(True, (begin[1:] > end[:-1]) | (begin[1:] < begin[:-1]))  # runs of one text often touch
                head = np.flatnonzero(joined)
                yield _out({"block": ([r["block"]], pa.int64()), "froms": ([begin[head].tobytes()], pa.binary()), "tos": ([np.maximum.reduceat(end, head).tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in _rows(batches):
            if held and any(held[-1][c] != row[c] for c in names):
                yield from solved(held)
                held = []
            held.append(row)
        if held:
            yield from solved(held)

    return run


def _cut(span: int, gram: int):
    """Every document of each block with what goes taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            block = _Block(row)
            gone = np.zeros(len(block.data) + 1, np.int64)
            for piece in row["spans"] or []:
                np.add.at(gone, np.frombuffer(piece["froms"], np.int64), 1)
                np.add.at(gone, np.frombuffer(piece["tos"], np.int64), -1)
            hashes, first, count, doc = block.runs(span, gram)
            own = block.settled(hashes, first, count, doc, span, gram)
            np.add.at(gone, first[own], 1)
            np.add.at(gone, first[own] + count[own] + span - 1, -1)
            mask = np.cumsum(gone[:-1]) > 0
            ends = np.cumsum(block.sizes)
            for k in block.copies:
                if block.sizes[k] >= span:
                    mask[ends[k] - block.sizes[k] : ends[k]] = True
            spans, removed, digests = [], [], []
            for size, end in zip(block.sizes.tolist(), ends.tolist(), strict=True):
                own = mask[end - size : end]
                removed.append(int(own.sum()))
                spans.append(int(np.count_nonzero(own[1:] & ~own[:-1]) + own[:1].sum()))
                digests.append(hashlib.sha256(block.data[end - size : end][~own].tobytes()).hexdigest())
            yield _out({"id": (row["ids"], pa.int64()), "n_bytes": (block.sizes, pa.int64()), "n_removed": (removed, pa.int64()), "n_spans": (spans, pa.int64()), "kept_sha256": (digests, pa.string())})

    return run


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of ``docs``.

    Texts are their UTF-8 bytes, whole, null the empty one; strings never cross documents and are judged on the input. A document
    shorter than ``span`` loses nothing; rows of one id do not remove each other's strings; a null id is greater than all
    others; other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    chosen = docs.select(column(key).cast("long").alias("id"), column(text).cast("string").alias("text"))
    total = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    name = f"trendlake_{uuid.uuid4().hex}"
    # fewer files than a shuffle has partitions would be shuffled in every join
    files = min(50_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / FILE_BYTES)))
    packed = chosen.mapInArrow(frugal(_pack), _BLOCK)
    packed.write.format("parquet").option("compression", "zstd").bucketBy(files, "block").option("path", scratch_path(spark, "blocks")).saveAsTable(name)
    blocks = spark.table(name)

    # of equal texts only the smallest id goes on
    each = blocks.select("block", F.posexplode(F.arrays_zip("ids", "digests")).alias("doc", "d"))
    each = materialize(each.select("block", "doc", F.coalesce("d.ids", F.lit(NO_ID)).alias("id"), F.col("d.digests").alias("digest")), "digests")
    first = each.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    later = lookup(each, first.where("n > 1"), ["digest"], F.xxhash64("block", "doc"), each.count()).where("id > first")
    copies = materialize(later.groupBy("block").agg(F.collect_list("doc").alias("copies")), "copies")
    whole = blocks.join(copies, "block", "left").select("block", "ids", "sizes", "data", "copies")

    buckets = max(16, math.ceil(total / BUCKET_BYTES))
    asked = whole.mapInArrow(frugal(_ask(buckets, span, gram)), "bucket int, block long, keys binary, many binary")
    answers = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(frugal(_answer), "block long, bucket int, bits binary, hits long")
    answers = materialize(answers, "answers")
    hits = answers.agg(F.sum("hits")).first()[0] or 0
    each_bucket = max(1, math.ceil(2 * hits / SHARD_ROWS / buckets))
    told = answers.where("hits > 0").groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))

    sent = whole.join(told, "block").mapInArrow(frugal(_send(buckets, each_bucket, span, gram)), _SENT)
    sizes = answers.groupBy("bucket").agg((F.sum("hits") / each_bucket).alias("__rows"))
    pieces = block_pairs(sent, ["bucket"], F.xxhash64("block", "firsts"), SHARD_ROWS, sizes)
    spans = gather(pieces, ["shard"]).mapInArrow(frugal(_remove(span, gram, PART_ROWS)), _SPANS)
    spans = materialize(spans, "spans")
    gone = spans.groupBy("block").agg(F.collect_list(F.struct("froms", "tos")).alias("spans"))

    found = whole.join(gone, "block", "left").mapInArrow(frugal(_cut(span, gram)), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    found = materialize(found, "removed")
    for done in (blocks, each, copies, answers, spans):
        release(done)
    spark.sql(f"DROP TABLE {name}")
    return found.withColumnRenamed("id", key)
