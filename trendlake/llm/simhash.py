"""Near-duplicates by SimHash fingerprints, linked through a self-join of binary tries.

A fingerprint has 64 bits; two link at ``BUDGET`` (4) or fewer differing bits. Distinct
fingerprints are dealt into tries by their leading bits under several bit orders: the 64 bits
form m blocks, and for each choice of m - 4 blocks those come first. Two linked fingerprints
agree on at least one choice, so they meet below one trie node with all of the error budget
left: the join is exact. Below that node, pairs of nodes are walked together level by level,
differing bits add up, and a pair is pruned once they exceed the budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendlake.llm.common import KEY, ROW, byte_values, column, connected_components, frugal, lookup, portions, unpack, with_row_key
from trendlake.llm.groups import block_pairs, forest, gather, starts, whole_groups
from trendlake.storage import materialize

WIDTH, SEED, BUDGET = 4, 42, 4
#: Rows of one trie in one task before the trie is split into pairs of sub-tries.
TRIE_ROWS = 512
#: Mean rows a trie that the number of blocks aims at.
TRIE_AIM = 64
_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes | None, width: int = WIDTH) -> int:
    """The signed 64-bit SimHash of one text: 0 without words; one shingle below ``width`` words."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= width:
        digests = xxhash.xxh64_digest(line, SEED)
    else:
        lengths = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lengths + 1) - 1
        digest = xxhash.xxh64_digest
        digests = b"".join(
            [digest(line[s:e], SEED) for s, e in zip((ends - lengths).tolist(), ends[width - 1 :].tolist(), strict=False)]
        )
    octets = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    if len(octets) < 64:
        set_bits = np.unpackbits(octets, axis=1).sum(axis=0, dtype=np.int64)
    else:
        set_bits = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _OF_BYTE for k in range(8)])
    return int(np.packbits(2 * set_bits > len(octets)).view(">i8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in portions(batches):
        values = [fingerprint(t) for t in byte_values(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["key", "fp"])


def fingerprints(docs: DataFrame, key: Column, text: Column) -> DataFrame:
    """Columns key and fp (signed long) for every row; texts are hashed where they are read."""
    chosen = docs.select(key.cast("long").alias("key"), text.cast("string").alias("text"))
    return chosen.mapInArrow(frugal(_fingerprint_batches), "key long, fp long")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def layouts(blocks: int, budget: int = BUDGET) -> list[list[tuple[int, int]]]:
    """For each table the bit ranges (start, width) in their order, chosen blocks first."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    ranges = [(edges[i], edges[i + 1] - edges[i]) for i in range(blocks)]
    tables = []
    for chosen in combinations(range(blocks), blocks - budget):
        tables.append([ranges[i] for i in chosen] + [r for i, r in enumerate(ranges) if i not in chosen])
    return tables


def _arranged(values: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    """The bits of ``values`` moved into the order of ``ranges``, the first ones highest."""
    out = np.zeros_like(values)
    for start, width in ranges:
        part = (values >> np.uint64(64 - start - width)) & np.uint64((1 << width) - 1)
        out = (out << np.uint64(width)) | part
    return out


def _products(a_lo: np.ndarray, a_n: np.ndarray, b_lo: np.ndarray, b_n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (left, right) positions of each pair of ranges."""
    n = a_n * b_n
    pair = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    return a_lo[pair] + at // b_n[pair], b_lo[pair] + at % b_n[pair]


def trie_pairs(keys: np.ndarray, roots: np.ndarray, budget: int = BUDGET, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Positions (a, b) of keys within ``budget`` bits, for each pair of trie nodes in ``roots``.

    ``keys`` are unsigned and sorted within each node; a row of ``roots`` is (a_lo, a_hi, b_lo,
    b_hi), equal ranges for a node with itself. A node is a range of keys with equal leading bits.
    """
    a_lo, a_hi, b_lo, b_hi = (roots[:, i] for i in range(4))
    spent = np.zeros(len(roots), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for bit in range(63, -2, -1):
        same = a_lo == b_lo
        done = (a_hi - a_lo) * (b_hi - b_lo) <= small
        if bit < 0:
            done[:] = True
        if done.any():
            x, y = _products(a_lo[done], (a_hi - a_lo)[done], b_lo[done], (b_hi - b_lo)[done])
            keep = x != y
            close = np.bitwise_count(keys[x[keep]] ^ keys[y[keep]]) <= budget
            x, y = x[keep][close], y[keep][close]
            found.append((np.minimum(x, y), np.maximum(x, y)))
        a_lo, a_hi, b_lo, b_hi, spent, same = (v[~done] for v in (a_lo, a_hi, b_lo, b_hi, spent, same))
        if not len(a_lo):
            break
        ones = np.concatenate([[0], np.cumsum(((keys >> np.uint64(bit)) & np.uint64(1)).astype(np.int64))])
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        cross = ~same
        children = [
            (a_lo, a_mid, b_lo, b_mid, spent),
            (a_mid, a_hi, b_mid, b_hi, spent),
            (a_lo, a_mid, b_mid, b_hi, spent + 1),
            tuple(v[cross] for v in (a_mid, a_hi, b_lo, b_mid, spent + 1)),
        ]
        a_lo, a_hi, b_lo, b_hi, spent = (np.concatenate(v) for v in zip(*children, strict=True))
        alive = (spent <= budget) & (a_hi > a_lo) & (b_hi > b_lo)
        a_lo, a_hi, b_lo, b_hi, spent = (v[alive] for v in (a_lo, a_hi, b_lo, b_hi, spent))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _join_batches(blocks: int, budget: int):
    tables = layouts(blocks, budget)
    names = ["t", "bucket", "__i", "__j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, names, 32_768):
            edges = starts(table, names)
            cost = np.cumsum(np.diff(edges) ** 2)
            for part in np.split(np.arange(len(edges) - 1), np.flatnonzero(np.diff(cost // 4_000_000)) + 1):
                rows = table.slice(edges[part[0]], edges[part[-1] + 1] - edges[part[0]])
                fp = rows["fp"].to_numpy().astype(np.int64)
                t, side = rows["t"].to_numpy(), rows["__side"].to_numpy()
                arranged = fp.view(np.uint64).copy()
                for k in np.unique(t):
                    arranged[t == k] = _arranged(fp[t == k].view(np.uint64), tables[k])
                group = np.repeat(np.arange(len(part)), np.diff(edges)[part])
                order = np.lexsort((arranged, side, group))
                fp, arranged, side, group = fp[order], arranged[order], side[order], group[order]
                lo = np.searchsorted(group, np.arange(len(part)))
                hi = np.append(lo[1:], len(group))
                ones = np.concatenate([[0], np.cumsum(side)])
                mid = hi - (ones[hi] - ones[lo])
                diagonal = (rows["__i"].to_numpy() == rows["__j"].to_numpy())[edges[part] - edges[part[0]]]
                roots = np.stack([lo, mid, np.where(diagonal, lo, mid), np.where(diagonal, mid, hi)], axis=1)
                a, b = trie_pairs(arranged, roots[(roots[:, 1] > roots[:, 0]) & (roots[:, 3] > roots[:, 2])], budget)
                if len(a):
                    root = forest(len(fp), a, b)
                    moved = np.flatnonzero(root != np.arange(len(fp)))
                    yield pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], ["u", "v"])

    return run


def links(distinct: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Edges (u, v) that join exactly the fingerprints of ``distinct(fp)`` reachable by links.

    Within a trie only a spanning forest of the links is returned: a large group of near copies
    gives as many rows as members, not pairs.
    """
    n = distinct.count()
    blocks = budget + 1
    while blocks < 2 * budget and n >> (64 // blocks * (blocks - budget)) > TRIE_AIM:
        blocks += 1
    tables = layouts(blocks, budget)
    buckets = []
    for ranges in tables:
        bucket = F.lit(0).cast("long")
        for start, width in ranges[: blocks - budget]:
            part = F.shiftrightunsigned("fp", 64 - start - width).bitwiseAND(F.lit((1 << width) - 1))
            bucket = F.shiftleft(bucket, width).bitwiseOR(part)
        buckets.append(bucket)
    rows = distinct.select("fp", F.posexplode(F.array(*buckets)).alias("t", "bucket"))
    keys = ["t", "bucket"]
    rows = block_pairs(rows, keys, F.xxhash64("fp"), TRIE_ROWS)
    return gather(rows, keys).mapInArrow(frugal(_join_batches(blocks, budget)), "u long, v long")


def components(prints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """For ``prints(key, fp)`` each fingerprint's class: columns fp, component (smallest key) and n, its rows.

    Equal fingerprints are one node, however many rows have them. Null keys are passed over; a
    class of null keys only has a null component.
    """
    nodes = materialize(prints.groupBy("fp").agg(F.min("key").alias("low"), F.count("*").alias("n")), "nodes")
    linked = connected_components(links(nodes.select("fp"), budget))
    linked = materialize(linked.withColumnRenamed("node", "fp").withColumnRenamed("component", "root"), "linked")
    classes = nodes.join(linked, "fp", "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("__size"))
    return lookup(classes, lowest, ["root"], F.xxhash64("fp"), nodes.count(), "__size").select("fp", "component", "n")


def classed(prints: DataFrame) -> DataFrame:
    """``prints(key, fp)`` with the component of each row, where one fingerprint may hold most rows."""
    return lookup(prints, materialize(components(prints), "classes"), ["fp"], F.xxhash64("key"), prints.count())


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint and component_id for every row of ``docs``.

    Null and empty texts have fingerprint zero and link like any other; texts of any length are hashed
    whole; repeated rows get the same class; other columns are not read; a null id has the class of its text; an empty table gives an empty result.
    """
    prints = materialize(fingerprints(docs, column(key), column(text)), "prints")
    found = classed(prints)
    return found.select(F.col("key").alias(key), hex_digits(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class of near-duplicates: the lowest id, of equal ids the first row.

    Rows keep all columns of ``docs``, whatever their names. A null id comes after all others. Null and
    empty texts are one class; an empty table gives no rows.
    """
    rows = with_row_key(docs)
    prints = materialize(fingerprints(rows, F.col(KEY), F.col(ROW)[text]), "prints")
    classes = classed(prints).select(F.col("key").alias(KEY), "component")
    ids = rows.select(KEY, F.col(ROW)[key].alias("__id"))
    order = F.struct(F.col("__id").isNull(), "__id", KEY)
    kept = classes.join(ids, KEY).groupBy("component").agg(F.min(order)[KEY].alias(KEY))
    return rows.join(kept.select(KEY), KEY, "left_semi").select(*unpack(rows, docs.columns))
