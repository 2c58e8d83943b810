"""Work on groups that a shuffle has brought together, with hot groups split into block pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = ["__i", "__j", "__side"]


def block_pairs(rows: DataFrame, keys: list[str], salt: Column, limit: int, sizes: DataFrame | None = None) -> DataFrame:
    """Copies of ``rows`` with columns ``__i, __j, __side`` for comparing all rows of a key.

    A key of at most ``limit`` rows is one block (0, 0). A larger one is dealt by ``salt`` into
    n blocks, and every pair of blocks i <= j becomes a group of its own of about two limits at
    most: all pairs of the key meet in some group, and no task holds the whole key. ``sizes`` gives the rows of
    keys in ``__rows`` where they are known or not what counts; these few keys are broadcast, so that ``rows`` are not shuffled for them.
    """
    few = F.broadcast if sizes is not None else lambda d: d
    if sizes is None:
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("__rows"))
    hot = sizes.where(F.col("__rows") > limit).select(*keys, F.ceil(F.col("__rows") / F.lit(limit)).cast("int").alias("__n"))
    n = F.coalesce("__n", F.lit(1))
    dealt = rows.join(few(hot), keys, "left").withColumn("__k", F.pmod(salt, n).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.select(
        *[c for c in rows.columns],
        F.least("__k", "__other").alias("__i"),
        F.greatest("__k", "__other").alias("__j"),
        (F.col("__k") > F.col("__other")).cast("int").alias("__side"),
    )


def gather(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Bring the rows of each (key, block pair) together, in order."""
    return rows.repartition(*keys, "__i", "__j").sortWithinPartitions(*keys, *BLOCK)


def starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """First row of each run of equal keys, and the number of rows at the end."""
    if not table.num_rows:
        return np.zeros(1, np.int64)
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for key in keys:
        values = table[key].combine_chunks().to_numpy(zero_copy_only=False)
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int) -> Iterator[pa.Table]:
    """Tables of ``least`` rows or more (but for the last) in which no group is cut."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            cut = int(starts(table, keys)[-2])
            if cut:
                yield table.slice(0, cut)
                held = table.slice(cut).combine_chunks().to_batches()
                rows -= cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node reachable from each of ``n`` nodes over the edges (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        for side in (root[a], root[b], a, b):
            np.minimum.at(root, side, low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(before, root):
            break
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root
