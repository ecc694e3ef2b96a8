"""A fixed-size bitmap of ids, to thin a table before it is shuffled for a join.

It lets some unwanted rows through, never drops a wanted one, and costs the same at any size: 2 ** BITS bits go to the
driver and to each executor. Hashes that are made within tasks are sent packed, by 2 ** PART slots, and not as rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 23
PART = 16  # bits of a slot within its part of a table


def _thinned(bitmap, at: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(bitmap.value, np.uint64)
        for batch in batches:
            slot = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            keep = (words[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
            if keep.any():
                out = batch.filter(pa.array(keep))
                yield out.select([n for n in out.schema.names if n != "_slot"])

    return run


def high_bits(spark: SparkSession, hashes: DataFrame, bits: int):
    """Broadcast bitmap of the top `bits` bits of 64-bit hashes (one long column)."""
    slot = F.shiftrightunsigned(F.col(hashes.columns[0]), 64 - bits)
    words = hashes.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.int64).view(np.uint64)
    return spark.sparkContext.broadcast(bitmap.tobytes())


def slots(spark: SparkSession, wanted: DataFrame, bits: int = BITS):
    """A function from a column to its slot, and the broadcast bitmap of the slots of the one column of `wanted`."""
    slot = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(1 << bits))
    s = wanted.select(slot(F.col(wanted.columns[0])).alias("s"))
    words = s.groupBy(F.shiftright("s", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.int64).view(np.uint64)
    return slot, spark.sparkContext.broadcast(bitmap.tobytes())


def thin(spark: SparkSession, df: DataFrame, col: str, wanted: DataFrame, bits: int = BITS) -> DataFrame:
    """Rows of `df` whose `col` may be among the values of the one column of `wanted`."""
    slot, bitmap = slots(spark, wanted, bits)
    rows = df.withColumn("_slot", slot(F.col(col)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return rows.mapInArrow(_thinned(bitmap, len(df.columns)), schema)


def packed(slot: np.ndarray, low: int, n: np.ndarray | None = None) -> pa.RecordBatch:
    """Ascending slots by part (their bits above `low`, 16 or 32): part, slots and, if given, one byte of `n` for each."""
    part = slot >> np.uint64(low)
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(slot)), bool), part[1:] != part[:-1])))
    off = np.concatenate((first, [len(slot)]))

    def binary(values: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer((off * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])

    cols = {"part": pa.array(part[first].view(np.int64)), "slots": binary((slot & np.uint64((1 << low) - 1)).astype(f"u{low // 8}"))}
    return pa.RecordBatch.from_pydict(cols if n is None else cols | {"n": binary(n)})


def first_two(values: np.ndarray) -> np.ndarray:
    """Sorted; of equal values two."""
    v = np.sort(values)
    return v[np.concatenate((np.ones(min(2, len(v)), bool), v[2:] != v[:-2]))]


def _joined(table: pa.Table, column: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), kind)


def _part(table: pa.Table, held: np.ndarray) -> pa.Table:
    return pa.table({"part": table.column("part").slice(0, 1), "held": pa.array([held.tobytes()], pa.binary())})


def _flags(table: pa.Table, slot: np.ndarray) -> pa.Table:
    flags = np.zeros(1 << PART, bool)
    flags[slot] = True
    return _part(table, np.packbits(flags, bitorder="little"))


def _any(table: pa.Table) -> pa.Table:
    return _flags(table, _joined(table, "slots", np.uint16))


def _twice(table: pa.Table) -> pa.Table:
    v = np.sort(_joined(table, "slots", np.uint32))
    return _flags(table, v[1:][v[1:] == v[:-1]] >> np.uint32(32 - PART))


def _sums(table: pa.Table) -> pa.Table:
    n = np.bincount(_joined(table, "slots", np.uint16), _joined(table, "n", np.uint8), 1 << PART)
    return _part(table, np.minimum(n, 255).astype(np.uint8))


def _collected(rows: DataFrame, fold, size: int, width: int) -> np.ndarray:
    got = rows.groupBy("part").applyInArrow(fold, "part long, held binary").toArrow()
    out = np.zeros((max(1, size // width), width), np.uint8)
    for part, held in zip(got.column("part").to_pylist(), got.column("held").to_pylist(), strict=True):
        out[part] = np.frombuffer(held, np.uint8)
    return out.ravel()[:size]


def any_bits(spark: SparkSession, rows: DataFrame, bits: int):
    """Broadcast bitmap of packed slots (`bits` bits, low = 16)."""
    return spark.sparkContext.broadcast(_collected(rows, _any, 1 << (bits - 3), 1 << (PART - 3)).tobytes())


def twice_bits(spark: SparkSession, rows: DataFrame, bits: int):
    """Broadcast bitmap of the top `bits` bits of packed slots (`bits` + 16 bits, low = 32) that come twice at least."""
    return spark.sparkContext.broadcast(_collected(rows, _twice, 1 << (bits - 3), 1 << (PART - 3)).tobytes())


def sums(rows: DataFrame, bits: int) -> np.ndarray:
    """Sum of `n`, 255 at most, for each packed slot (`bits` bits, low = 16)."""
    return _collected(rows, _sums, 1 << bits, 1 << PART)


def _with_bit(bitmap, at: int, bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.frombuffer(bitmap.value, np.uint64)
        for batch in batches:
            slot = (batch.column(at).to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
            keep = (words[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
            if keep.any():
                yield batch.filter(pa.array(keep))

    return run


def with_bit(df: DataFrame, col: str, bitmap, bits: int) -> DataFrame:
    """Rows of `df` whose hash `col` has its top `bits` bits in the bitmap."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(_with_bit(bitmap, df.columns.index(col), bits), schema)
