"""Hard negatives by Fagin's threshold algorithm over integer vectors.

Rows are dealt into blocks and anchors into chunks; a task has one block and one chunk. The block keeps, for
each dimension, its candidates sorted by that component. An anchor reads each list from the end that its own
component's sign favours, all lists to the same depth; every row met for the first time is scored in full
(random access). The products of the anchor with the components last read are a threshold that no row
still unseen exceeds. Reading stops once it lies strictly below the k-th score of every window, or
below the window itself. Windows are the best rows of the anchor's own label first (positives), then for each
positive the best rows of other labels whose score lies in its share of the positive's (negatives).
Tasks return at most k rows for each window, and Spark merges those of all blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NullType

from trendlake.llm.common import column, frugal
from trendlake.llm.groups import starts, whole_groups
from trendlake.storage import materialize

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 10, 30, 90, 256
#: Rows of a block (a 64th of all between these bounds) and anchors of a chunk: neither changes a result.
LEAST_ROWS, MOST_ROWS, BLOCKS, CHUNK = 4_096, 65_536, 64, 8_192
#: Depth of the first sorted access; it doubles from step to step.
DEPTH = 32


def quantized(column_: pa.ListArray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every row, shorter vectors filled with zeros: float64 where exact, else Python integers."""
    if isinstance(column_, pa.ChunkedArray):
        column_ = column_.combine_chunks()
    flat = np.floor(column_.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    sizes = np.diff(column_.offsets.to_numpy())
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def exact(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both of one width and of a type in which every inner product of their rows is exact."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    bound = width * np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if bound < 2**24:
        return a.astype(np.float32), b.astype(np.float32)
    if bound < 2**53:
        return a, b
    whole = np.frompyfunc(int, 1, 1)
    return whole(a).astype(object), whole(b).astype(object)


class Lists:
    """The candidates ``x`` with their ids, sorted by every dimension."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.up = np.argsort(x, axis=0, kind="stable")
        self.down = self.up[::-1]

    def search(self, anchor: np.ndarray, windows: list[tuple[int, int | None, int | None]], fit: np.ndarray | None = None) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """For each window (k, low, high) the rows of the k best scores in low <= 100 * score <= high, ties by id, and the depth read.

        ``fit`` masks the rows that may be returned.
        """
        n = len(self.x)
        rises, falls = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        seen = np.zeros(n, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        found = [(rows, scores)] * len(windows)
        depth, size = 0, DEPTH
        open_ = [w for w, (_, low, high) in enumerate(windows) if low is None or high is None or low <= high]
        while n and open_:
            if depth:
                last_up, last_down = self.x[self.down[depth - 1, rises], rises], self.x[self.up[depth - 1, falls], falls]
                threshold = int(np.dot(anchor[rises], last_up)) + int(np.dot(anchor[falls], last_down)) if len(rises) + len(falls) else 0
                still = []
                for w in open_:
                    k, low, high = windows[w]
                    inside = (True if low is None else 100 * scores >= low) & (True if high is None else 100 * scores <= high) & np.ones(len(scores), bool)
                    mine = np.flatnonzero(inside)
                    if len(mine) > k:
                        cut = np.partition(scores[mine], len(mine) - k)[len(mine) - k]
                        mine = mine[scores[mine] >= cut]
                        mine = mine[np.lexsort((self.ids[rows[mine]], -scores[mine]))[:k]]
                    found[w] = (rows[mine], scores[mine])
                    kth = scores[mine].min() if len(mine) == k else None
                    if depth < n and not (kth is not None and threshold < kth) and not (low is not None and 100 * threshold < low):
                        still.append(w)
                open_ = still
                if not open_:
                    break
            to = min(n, depth + size)
            met = np.concatenate([self.down[depth:to, rises].ravel(), self.up[depth:to, falls].ravel()]) if len(rises) + len(falls) else np.arange(n)
            fresh = np.zeros(n, bool)
            fresh[met] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh if fit is None else fresh & fit)
            rows = np.concatenate([rows, new])
            scores = np.concatenate([scores, (self.x[new] @ anchor).astype(np.int64)])
            depth = n if seen.all() else to
            size *= 2
        return found, depth


def _by_group(batches: Iterator[pa.RecordBatch], names: list[str], search) -> Iterator[pa.RecordBatch]:
    """``search(rows, anchors)`` for each group that holds a block's rows and a chunk's anchors."""
    for table in whole_groups(batches, names, 1):
        edges = starts(table, names)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            part = table.slice(lo, hi - lo)
            mask = part["anchor"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
            anchors, rows = part.filter(pa.array(mask)), part.filter(pa.array(~mask))
            if len(anchors) and len(rows):
                yield from search(rows, anchors)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().to_numpy(zero_copy_only=False)


def _positives(k: int, scale: int):
    names = ["block", "chunk"]

    def search(rows: pa.Table, anchors: pa.Table) -> Iterator[pa.RecordBatch]:
        x, a = exact(quantized(rows["embedding"], scale), quantized(anchors["embedding"], scale))
        nodes, ids, labels = _column(rows, "node"), _column(rows, "id"), _column(rows, "label")
        own_node, own_label = _column(anchors, "node"), _column(anchors, "label")
        out: list[tuple] = []
        for label in np.unique(own_label):
            at = np.flatnonzero(labels == label)
            lists = Lists(x[at], ids[at])
            for j in np.flatnonzero(own_label == label):
                [(hits, scores)], _ = lists.search(a[j], [(k, None, None)], nodes[at] != own_node[j])
                out.append((np.full(len(hits), own_node[j]), nodes[at][hits], ids[at][hits], scores))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "peer", "peer_id", "score"])

    return lambda batches: _by_group(batches, names, search)


def _negatives(k: int, low: int, high: int, scale: int):
    names = ["block", "chunk"]

    def search(rows: pa.Table, anchors: pa.Table) -> Iterator[pa.RecordBatch]:
        x, a = exact(quantized(rows["embedding"], scale), quantized(anchors["embedding"], scale))
        nodes, ids, labels = _column(rows, "node"), _column(rows, "id"), _column(rows, "label")
        lists = Lists(x, ids)
        given = zip(_column(anchors, "node"), _column(anchors, "label"), anchors["scores"].to_pylist(), strict=True)
        fits = {label: labels != label for label in np.unique(_column(anchors, "label"))}
        out: list[tuple] = []
        for j, (node, label, scores) in enumerate(given):
            windows = [(k, low * s, high * s) for s in scores]
            for place, (hits, s) in enumerate(lists.search(a[j], windows, fits[label])[0]):
                out.append((np.full(len(hits), node), np.full(len(hits), place, np.int32), nodes[hits], ids[hits], s))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["node", "place", "peer", "peer_id", "score"])

    return lambda batches: _by_group(batches, names, search)


def _met(rows: DataFrame, anchors: DataFrame, blocks: int, chunks: int) -> DataFrame:
    """Every block of rows beside every chunk of anchors, sorted by both."""
    r = rows.select("block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(False).alias("anchor"), "node", "id", "label", "embedding", F.lit(None).cast("array<long>").alias("scores"))
    a = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "chunk", F.lit(True).alias("anchor"), "node", "id", "label", "embedding", "scores")
    return r.unionByName(a).repartition("block", "chunk").sortWithinPartitions("block", "chunk")


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    key: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for every row that ``is_anchor``.

    A row's score is the inner product of its and the anchor's components, each floor(scale * x); higher scores come
    first, ties by the smaller id. Positives are the first ``positives`` other rows of the anchor's label; negatives the first
    ``negatives`` rows of other labels with low% to high% of the positive's score. Rows whose id, label or vector is null, or that
    hold null or non-finite components, take no part; missing components of shorter vectors count as zero; repeated ids
    are rows of their own, and an anchor's own row is no positive of it; a score beyond 64 bits raises; ``is_anchor`` reads
    the columns of ``vectors``, others are not read; an empty table, or one without anchors, gives no rows.
    """
    kind = "long" if isinstance(vectors.schema[label].dataType, (NullType, IntegralType)) else "string"
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    rows = vectors.select(
        F.monotonically_increasing_id().alias("node"), column(key).cast("long").alias("id"), column(label).cast(kind).alias("label"),
        column(embedding).cast("array<double>").alias("embedding"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    rows = rows.where("id is not null and label is not null and embedding is not null").where(~bad)
    rows = materialize(rows.withColumn("embedding", F.col("embedding").cast(vectors.schema[embedding].dataType)), "vectors")
    total, asked = rows.agg(F.count("*"), F.count_if("is_anchor")).first()
    blocks = max(1, math.ceil(total / min(MOST_ROWS, max(LEAST_ROWS, total // BLOCKS))))
    chunks = max(1, math.ceil(asked / CHUNK))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"))
    anchors = rows.where("is_anchor").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(chunks)).cast("int"))

    none = anchors.withColumn("scores", F.lit(None).cast("array<long>"))
    near = _met(placed, none, blocks, chunks).mapInArrow(frugal(_positives(positives, scale)), "node long, peer long, peer_id long, score long")
    order = [F.desc("score"), F.col("peer_id"), F.col("peer")]
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(*order)) - 1).where(F.col("place") < positives)
    near = materialize(near, "positives")

    scores = near.groupBy("node").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "score"))), lambda s: s["score"]).alias("scores"))
    schema = "node long, place int, peer long, peer_id long, score long"
    hard = _met(placed, anchors.join(scores, "node"), blocks, chunks).mapInArrow(frugal(_negatives(negatives, low, high, scale)), schema)
    rank = F.row_number().over(Window.partitionBy("node", "place").orderBy(*order))
    hard = hard.withColumn("rank", rank).where(F.col("rank") <= negatives)
    hard = hard.select("node", "place", "rank", F.col("peer_id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("node", "place", F.col("peer_id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = anchors.select("node", F.col("id").alias("anchor_id"))
    found = hard.join(near, ["node", "place"]).join(named, "node")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
