"""Integer codes of postings: gaps and variable bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def gap_encode(values: Column) -> Column:
    """First value, then differences. Fails on values that don't ascend."""
    gaps = F.transform(values, lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.get(values, i - 1)))
    bad = lambda g: F.exists(F.slice(g, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0))), lambda x: x < 0)
    checked = F.transform(F.array(gaps), lambda g: F.when(bad(g), F.raise_error(F.lit("values must ascend"))).otherwise(g))  # a lambda, so that gaps are made once
    return F.get(checked, F.lit(0))


def gap_decode(gaps: Column) -> Column:
    """Running sums."""
    start = F.lit(None).cast("array<bigint>")
    step = lambda acc, g: F.when(acc.isNull(), F.array(g.cast("bigint"))).otherwise(F.concat(acc, F.array(F.element_at(acc, -1) + g)))
    return F.coalesce(F.aggregate(gaps, start, step), F.array().cast("array<bigint>"))


def vbyte(numbers) -> bytes:
    """Seven bits a byte, most significant first; the high bit says that more bytes follow."""
    out = bytearray()
    for n in numbers:
        if n < 0:
            raise ValueError("negative")
        groups = [n & 127]
        while n := n >> 7:
            groups.append(n & 127 | 128)
        out += bytes(reversed(groups))
    return bytes(out)


def unvbyte(data: bytes) -> list[int]:
    out, n = [], 0
    for b in data:
        n = n << 7 | b & 127
        if b < 128:
            out.append(n)
            n = 0
    return out


def flat_lists(batch: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a batch of lists, and how many each list has; null lists have none."""
    numbers = batch.flatten()
    if numbers.null_count:
        raise ValueError("null in a list")
    return numbers.to_numpy(zero_copy_only=False).astype(np.int64, copy=False), pc.list_value_length(batch).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def parted(kind: pa.DataType, held: np.ndarray, data: pa.Buffer | pa.Array, like: pa.Array) -> pa.Array:
    """Data cut into binary values, or numbers into lists, of as many as held says; null where `like` is."""
    ends = np.concatenate([[0], np.cumsum(held)])
    if ends[-1] > np.iinfo(np.int32).max:
        raise ValueError("over 2 GB in a batch")
    there = pa.py_buffer(np.packbits(like.is_valid().to_numpy(zero_copy_only=False), bitorder="little")) if like.null_count else None
    offsets = pa.py_buffer(ends.astype(np.int32))
    if isinstance(data, pa.Buffer):
        return pa.Array.from_buffers(kind, len(held), [there, offsets, data])
    return pa.Array.from_buffers(kind, len(held), [there, offsets], children=[data])


def coded(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of non-negative numbers, one after the other, and how many each takes."""
    if len(numbers) and numbers.min() < 0:
        raise ValueError("negative")
    sizes = np.ones(len(numbers), np.int64)
    for j in range(1, 9):
        sizes += numbers >= 1 << 7 * j
    ends, out = np.cumsum(sizes), np.zeros(int(sizes.sum()), np.uint8)
    for j in range(int(sizes.max(initial=0))):
        has = sizes > j
        out[ends[has] - 1 - j] = numbers[has] >> 7 * j & 127 | (128 if j else 0)
    return out, sizes


def uncoded(data: np.ndarray) -> np.ndarray:
    """The numbers in bytes that coded() made."""
    ends = np.flatnonzero(data < 128)
    sizes, out = np.diff(ends, prepend=-1), np.zeros(len(ends), np.int64)
    for j in range(int(sizes.max(initial=0))):
        has = sizes > j
        out[has] |= (data[ends[has] - j].astype(np.int64) & 127) << 7 * j
    return out


def vbyte_encode(values: Column) -> Column:
    """vbyte() of lists of numbers below 2^63; a batch at once, in the memory it came in."""

    @F.arrow_udf("binary")
    def encoded(batch: pa.Array) -> pa.Array:
        numbers, held = flat_lists(batch)
        data, sizes = coded(numbers)
        cuts = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(held)])]
        return parted(pa.binary(), np.diff(cuts), pa.py_buffer(data), batch)

    return encoded(values)


def vbyte_decode(data: Column) -> Column:
    @F.arrow_udf("array<long>")
    def decoded(batch: pa.Array) -> pa.Array:
        full = (batch.fill_null(b"") if batch.null_count else batch).cast(pa.binary())
        cuts = np.frombuffer(full.buffers()[1], np.int32)[full.offset : full.offset + len(full) + 1] if len(full) else np.zeros(1, np.int32)
        every = np.frombuffer(full.buffers()[2] or b"", np.uint8)[cuts[0] : cuts[-1]]
        numbers, before = uncoded(every), np.concatenate([[0], np.cumsum(every < 128)])
        return parted(pa.list_(pa.int64()), np.diff(before[cuts - cuts[0]]), pa.array(numbers), batch)

    return decoded(data)


def vbyte_size(values: Column) -> Column:
    """Bytes that vbyte_encode takes, without Python."""
    long = lambda x: F.greatest(F.lit(1), F.ceil(F.length(F.bin(x.cast("long"))) / 7)).cast("long")
    one = lambda x: F.when(x.between(0, 127), F.lit(1).cast("long")).when(x.between(128, 16383), F.lit(2).cast("long")).otherwise(long(x))
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + one(x))
