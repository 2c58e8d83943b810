"""Near-duplicate vectors by a pivot-permutation index.

Every vector is described by its ``NEAREST`` pivots in order of nearness. Inverted lists hold,
for each label and pivot, the vectors that name it; two vectors are candidates when they share
at least ``SHARED`` pivots, and candidates are verified by their cosine in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegralType, NullType

from trendlake.llm.common import column, connected_components, frugal, lookup
from trendlake.llm.groups import block_pairs, forest, gather, starts, whole_groups
from trendlake.storage import materialize

THRESHOLD = 0.93
NEAREST, SHARED = 8, 2
#: Pivots: at least LEAST_PIVOTS, and PIVOT_RATE times the root of the number of vectors, so that
#: lists grow with the root of the input, up to MOST_PIVOTS (190 million vectors): beyond, lists grow
#: with the input, and nothing is left out. They are the sample that the index is fitted on.
LEAST_PIVOTS, PIVOT_RATE, MOST_PIVOTS = 128, 1.2, 16_384
#: Two pivots have at most this cosine, else a group of near copies would hold many of them and its
#: members would name nearly random ones.
APART = 0.8
LIST_ROWS = 512


def _unit(flat: pa.ListArray) -> np.ndarray:
    rows = len(flat)
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_dimension(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors of each dimension in a batch."""
    sizes = np.diff(column.offsets.to_numpy())
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, _unit(column.take(pa.array(at)))


def _list(table: pa.Table, name: str) -> pa.ListArray:
    column = table[name]
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def thinned(pivots: np.ndarray, apart: float = APART) -> np.ndarray:
    """Unit vectors of ``pivots``, in order, without those too near to one kept before."""
    kept = np.zeros_like(pivots)
    n = 0
    for x in pivots:
        if not n or (kept[:n] @ x).max() <= apart:
            kept[n] = x
            n += 1
    return kept[:n]


def _describe(pivots: np.ndarray, nearest: int):
    nearest = min(nearest, len(pivots))
    width = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("embedding"))
            order = np.zeros((batch.num_rows, nearest), np.int32)
            for at, x in _by_dimension(column):
                d = min(width, x.shape[1])
                for s in range(0, len(at), 1024):
                    near = x[s : s + 1024, :d] @ pivots[:, :d].T
                    order[at[s : s + 1024]] = np.argsort(-near, axis=1, kind="stable")[:, :nearest]
            lists = pa.ListArray.from_arrays(np.arange(0, order.size + 1, nearest, dtype=np.int32), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "nearest"])

    return run


def _verify(threshold: float, shared: int, n_pivots: int):
    names = ["label", "dims", "pivot", "__i", "__j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, names, 2_048):
            nodes, cnt = table["node"].to_numpy(), table["copies"].to_numpy()
            side, pivot = table["__side"].to_numpy(), table["pivot"].to_numpy()
            i, j = table["__i"].to_numpy(), table["__j"].to_numpy()
            edges = starts(table, names)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                n = hi - lo
                if n < 2:
                    continue
                x = _unit(_list(table.slice(lo, n), "embedding"))
                near = _list(table.slice(lo, n), "nearest").flatten().to_numpy().reshape(n, -1)
                used, at = np.unique(near, return_inverse=True)
                names_ = np.zeros((n, len(used)), np.float32)
                np.put_along_axis(names_, at.reshape(n, -1), 1, axis=1)
                earlier = names_ * (used < pivot[lo])
                left = np.flatnonzero(side[lo:hi] == 0)
                right = np.flatnonzero(side[lo:hi] == 1) if i[lo] < j[lo] else left
                hit = (names_[left] @ names_[right].T >= shared) & (earlier[left] @ earlier[right].T == 0)
                hit &= x[left] @ x[right].T >= threshold
                if i[lo] == j[lo]:
                    np.fill_diagonal(hit, False)
                if not hit.any():
                    continue
                own = cnt[lo:hi]
                linked = np.zeros(n, np.int64)
                linked[left] += hit @ own[right]
                if i[lo] < j[lo]:
                    linked[right] += hit.T @ own[left]
                a, b = np.nonzero(hit)
                root = forest(n, left[a], right[b])
                some = np.flatnonzero(linked)
                out.append((nodes[lo:hi][some], linked[some], nodes[lo:hi][root[some]]))
            if out:
                columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["node", "links", "peer"])

    return run


def near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    nearest: int = NEAREST,
    shared: int = SHARED,
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of ``vectors``.

    Only rows with equal labels, numbers or texts, are compared; vectors of doubles keep all digits. A null label, and a vector that is null, empty,
    zero or holds null or non-finite numbers, links with nothing: it has no links and is its own
    component. Vectors of different lengths never link. Equal vectors under one label are one
    node with a number of copies, each linked with the others. Repeated ids count as separate
    vectors. Links are counted inside a task, so a large group gives a row for each member in
    each list, never its pairs. Other columns are not read; an empty table gives no rows.
    """
    given, labels = vectors.schema[embedding].dataType, vectors.schema[label].dataType
    kept = "array<float>" if isinstance(given, ArrayType) and isinstance(given.elementType, FloatType) else "array<double>"
    whole = "long" if isinstance(labels, (NullType, IntegralType)) else "string"
    rows = vectors.select(
        column(key).cast("long").alias("vec"), column(label).cast(whole).alias("label"), column(embedding).cast(kept).alias("embedding")
    )
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    some = F.exists("embedding", lambda v: v != 0)
    usable = F.coalesce(F.col("label").isNotNull() & ~bad & some, F.lit(False))
    nodes = rows.where(usable).groupBy("label", "embedding").agg(F.min("vec").alias("low"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()).withColumn("dims", F.size("embedding")), "vectors")

    n = nodes.count()
    wanted = int(min(MOST_PIVOTS, max(LEAST_PIVOTS, math.ceil(PIVOT_RATE * math.sqrt(n)))))
    sample = nodes.orderBy(F.xxhash64("label", "embedding"), "node").limit(wanted).select("embedding").collect()
    if sample:
        width = max(len(r[0]) for r in sample)
        pivots = np.zeros((len(sample), width))
        for at, r in enumerate(sample):
            x = np.asarray(r[0], np.float64)
            pivots[at, : len(x)] = x / np.abs(x).max()
        pivots = thinned(pivots / np.sqrt((pivots**2).sum(axis=1, keepdims=True)))
    else:
        pivots = np.zeros((1, 1))
    if len(pivots) <= nearest:  # every vector would name all of them: one list holds all pairs
        pivots, shared = pivots[:1], 1

    schema = f"node long, label {whole}, dims int, copies long, embedding {kept}, nearest array<int>"
    described = nodes.select("node", "label", "dims", "copies", "embedding").mapInArrow(frugal(_describe(pivots, nearest)), schema)
    lists = described.withColumn("pivot", F.explode("nearest"))
    keys = ["label", "dims", "pivot"]
    lists = block_pairs(lists, keys, F.xxhash64("node"), LIST_ROWS)
    found = gather(lists, keys).mapInArrow(frugal(_verify(threshold, shared, len(pivots))), "node long, links long, peer long")
    found = materialize(found, "links")

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = connected_components(found.select(F.col("node").alias("u"), F.col("peer").alias("v")))
    classes = nodes.join(linked, "node", "left").select("node", "label", "embedding", "low", "copies", F.coalesce("component", "node").alias("root"))
    lowest = classes.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("size"))
    classes = lookup(classes, lowest, ["root"], F.xxhash64("node"), n, "size").join(counts, "node", "left")
    classes = classes.select("label", "embedding", "copies", "component", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    classes = materialize(classes, "classes")

    total = classes.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    probe = rows.where(usable).select("vec", "label", "embedding")
    placed = lookup(probe, classes, ["label", "embedding"], F.xxhash64("vec"), total, "copies").select("vec", "links", F.coalesce("component", "vec").alias("component"))
    # rows that cannot link need no partner, so they are not shuffled
    alone = rows.where(~usable).select("vec", F.lit(0).cast("long").alias("links"), F.col("vec").alias("component"))
    return placed.unionByName(alone).select(
        F.col("vec").alias(key),
        F.col("links").cast("long").alias("n_links"),
        F.col("component").alias("component_id"),
        F.coalesce(F.col("vec") == F.col("component"), F.lit(False)).alias("kept"),
    )
