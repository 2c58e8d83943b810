"""Packing of token sequences by Karmarkar-Karp multiway differencing.

Each partition packs the documents that it reads: whole windows are cut off every document, the
rest is cut into items of at most ``ITEM`` tokens, and items are collected until they fill
``WINDOWS`` windows but for ``SLACK`` tokens in each; the last ``FINE`` tokens for each window
are cut small, so that the sums can be evened out. The largest differencing method then
spreads them: partial partitions are merged two at a time, the most uneven first, large parts
against small ones. Where a window exceeds its capacity, there is one window more and the
items are spread anew. Nothing is shuffled, and a task holds one group of windows at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from trendlake.llm import vocab
from trendlake.llm.common import column, frugal

CAPACITY, END = 2048, 1
WINDOWS, SLACK, ITEM = 64, 4, 512
FINE, FINE_SIZES = 40, (48, 24, 12, 6, 3)
_size = itemgetter(0)


def differencing(sizes: list[int], windows: int) -> list[tuple[int, list[int]]]:
    """Items (by number) spread over ``windows`` parts of nearly equal sums, largest first.

    A partial partition is a list of its non-empty parts in falling order. Two are merged by
    adding the largest parts of one to the smallest of the other.
    """
    heap = [(-s, k, [(s, k)]) for k, s in enumerate(sizes)]
    heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heappop(heap)
        _, _, b = heappop(heap)
        over = len(a) + len(b) - windows
        if over <= 0:
            parts = a + b
        else:
            alone = len(a) - over
            joined = [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[alone:], reversed(b[len(b) - over :]), strict=True)]
            parts = a[:alone] + joined + b[: len(b) - over]
        parts.sort(key=_size, reverse=True)
        low = parts[-1][0] if len(parts) == windows else 0
        heappush(heap, (low - parts[0][0], tie, parts))
        tie += 1
    out = []
    for total, tree in heap[0][2] if heap else []:
        members, stack = [], [tree]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                members.append(x)
        out.append((total, sorted(members)))
    return out


def spread(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of item numbers, none over ``capacity``; as few as differencing allows."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, windows)
        if not parts or parts[0][0] <= capacity:
            return [members for _, members in parts]
        windows += 1


def cut_rest(n: int, item: int = ITEM) -> list[int]:
    """A remainder of ``n`` tokens as nearly equal items of at most ``item``."""
    k = -(-n // item)
    return [n // k + (i < n % k) for i in range(k)] if n else []


def _pack(path: str, capacity: int):
    budget = WINDOWS * (capacity - SLACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocab.loaded(vocab.WordCoder, path)
        end = vocab.packed([END])
        sequence = TaskContext.get().partitionId() << 32
        held: list[tuple] = []  # doc, start, length, crc, doc tokens
        load = 0
        rows: list[list] = [[] for _ in range(7)]

        def put(piece: tuple, number: int, offset: int) -> None:
            for column, value in zip(rows, (*piece, number, offset), strict=True):
                column.append(value)

        def settle() -> None:
            nonlocal sequence, held, load
            for members in spread([p[2] for p in held], capacity):
                offset = 0
                for k in members:
                    put(held[k], sequence, offset)
                    offset += held[k][2]
                sequence += 1
            held, load = [], 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], NAMES)
            for c in rows:
                c.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = coder.encode(text) + end if text else end
                n = len(ids) // 4
                full = n // capacity
                for k in range(full):
                    crc = zlib.crc32(ids[4 * k * capacity : 4 * (k + 1) * capacity])
                    put((doc, k * capacity, capacity, crc, n), sequence, 0)
                    sequence += 1
                start = full * capacity
                for size in cut_rest(n - start):
                    while size:
                        coarse = budget - WINDOWS * FINE - load
                        take = min(size, coarse if coarse > 0 else min(FINE_SIZES[len(held) % len(FINE_SIZES)], budget - load))
                        held.append((doc, start, take, zlib.crc32(ids[4 * start : 4 * (start + take)]), n))
                        start, size, load = start + take, size - take, load + take
                        if load == budget:
                            settle()
            if len(rows[0]) >= 20_000:
                yield flush()
        settle()
        yield flush()

    return run


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: where it stands in its document and in which sequence.

    Every document's ids end with ``END``; a null or empty text has that id alone; a text of any length
    is encoded whole and cut into as many windows as it fills. Other columns are not read. Repeated rows
    are packed each on its own; null ids stay null; an empty table gives no rows. Sequence
    numbers are unique over the whole table: the partition's number above, a count below.
    """
    chosen = docs.select(column(key).cast("long").alias("doc_id"), column(text).cast("string").alias("text"))
    schema = ", ".join(f"{n} long" for n in NAMES)
    return chosen.mapInArrow(frugal(_pack(tokenizer_path, capacity), holds=True), schema)
