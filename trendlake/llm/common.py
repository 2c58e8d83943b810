"""Helpers that the operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trendlake.storage import materialize, release

ROW = "__tl_row"
KEY = "__tl_key"
#: A key is hot where it holds a ``HOT``-th of all rows (so at most that many are) and ``LEAST_HOT`` rows.
HOT, LEAST_HOT = 512, 1_000


def with_row_key(df: DataFrame) -> DataFrame:
    """``df`` packed as struct ``__tl_row`` beside a stable unique ``__tl_key``.

    The table is written once, so the key is the same for every later reader; the struct
    keeps any column name of the input from clashing with working columns.
    """
    packed = df.select(F.monotonically_increasing_id().alias(KEY), F.struct("*").alias(ROW))
    return materialize(packed, "rows")


def unpack(df: DataFrame, columns: list[str]) -> list[Column]:
    """The original columns out of ``__tl_row``."""
    return [F.col(ROW)[c].alias(c) for c in columns]


#: What a worker keeps from task to task, such as tokenizers.
_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable[[], object]):
    """What ``make`` gives, once for each worker process, until a task of another kind begins there."""
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Drop what the worker holds from tasks of another kind, and give the memory back."""
    if _HELD:
        _HELD.clear()
        give_back()


def give_back() -> None:
    """Give freed memory back to the system: allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], holds: bool = False) -> Callable:
    """``run`` for mapInArrow with freed memory given back to the system at a task's end.

    Workers live on through later stages and operators. Where ``run`` uses :func:`held`, it says so;
    other tasks let go of what was held.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not holds:
            let_go()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def portions(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that few texts are held twice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_values(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a text column without decoding it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def slices(texts: list[bytes | None], limit: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose texts have at most ``limit`` bytes together (or one row)."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def column(name: str) -> Column:
    """The column of that very name, blanks and dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_fields(schema: StructType, more: str) -> StructType:
    """``schema`` with the fields of a DDL string behind its own."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], spread: Column, total: int, count: str = "n", how: str = "inner") -> DataFrame:
    """``rows`` with the other columns of ``table``, inner or left, where a few keys may hold most rows.

    ``table`` has each key once and in ``count`` how many of the ``total`` rows have it. Hot keys,
    at most ``HOT`` of them, are broadcast; all others are joined by shuffle, where the
    rows of hot keys, which find nothing there, are dealt out by ``spread``, a stored column.
    """
    limit = max(LEAST_HOT, total // HOT)
    values = [c for c in table.columns if c not in (*keys, count)]
    hot = table.where(F.col(count) >= limit).select(*keys, F.struct(*values).alias("__hot"))
    rest = table.where(F.col(count) < limit).select(*keys, F.lit(0).cast("long").alias("__salt"), F.struct(*values).alias("__rest"))
    dealt = rows.join(F.broadcast(hot), keys, "left")
    dealt = dealt.withColumn("__salt", F.when(F.col("__hot").isNull(), F.lit(0)).otherwise(F.pmod(spread, F.lit(1 << 20)) + 1).cast("long"))
    found = dealt.join(rest, [*keys, "__salt"], "left").withColumn("__value", F.coalesce("__hot", "__rest"))
    found = found.where("__value is not null") if how == "inner" else found
    return found.select(*rows.columns, *[F.col("__value")[v].alias(v) for v in values])


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node of ``edges(u, v)``: columns node, component.

    Alternating large-star and small-star rounds: both are grouped minima (combined before
    the shuffle) and equi joins, and the number of edges never grows. Each round is written to
    the shared folder, so no lineage builds up. Nulls and self loops are left out; an empty
    input gives an empty result. A node that most edges share, as the root of a giant component
    is, has its minimum broadcast (see :func:`lookup`). Raises if the rounds run out, rather than
    give a partial answer.
    """
    state = materialize(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    seen, count = None, state.count()
    for _ in range(rounds):
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = lookup(both.where("v > u"), low, ["u"], F.xxhash64("v"), 2 * count)
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = (
            lookup(large, low, ["u"], F.xxhash64("v"), count)
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        following = materialize(small, "edges")
        release(state)
        state = following
        sign = state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sign == seen:
            roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        seen, count = sign, sign[0]
    raise RuntimeError(f"components did not settle in {rounds} rounds")
