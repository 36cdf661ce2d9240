"""Sketches of a whole table: partial ones per task, merged level by level, read back as one bounded array.

``counted`` holds a counter per bucket (how often values fall there), ``repeated`` one bit per bucket: whether two or
more values fell there. Either overestimates only: a value that occurs twice is never missed. Their size is fixed by
``bits``, whatever the size of the table, so the driver and a broadcast hold a proven number of bytes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingsift.functions.shared import written

#: Partial sketches that one merging task takes at most: more tasks merge in further levels.
FAN_IN = 128
#: Values that a task gathers before it writes them into a partial sketch.
FLUSH = 4_000_000
PARTIAL = "block int, part int, data binary"
_BLOCK_BITS = 18


def buckets(values: np.ndarray, bits: int, row: int = 0) -> np.ndarray:
    """The bucket of each 64-bit value in one of the sketch's rows of hash functions."""
    odd = np.uint64((0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F)[row])
    return ((values * odd) >> np.uint64(64 - bits)).astype(np.uint32)


def _packed_ids(ids: np.ndarray, twice: np.ndarray) -> bytes:
    """Sorted distinct ids with one flag each: steps between ids in single bytes (255 goes on to the next byte), then the
    flags as bits."""
    steps = np.diff(ids.astype(np.int64), prepend=-1)
    over = steps // 255
    ends = np.cumsum(over + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = steps % 255
    return len(out).to_bytes(4, "little") + out.tobytes() + np.packbits(twice).tobytes()


def _unpacked_ids(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:4], "little")
    steps = np.frombuffer(data, np.uint8, n, 4)
    ids = (np.cumsum(steps, dtype=np.int64) - 1)[steps != 255]
    return ids, np.unpackbits(np.frombuffer(data, np.uint8, offset=4 + n), count=len(ids))


def partial_repeated(values: Iterable[np.ndarray], bits: int, rows: int = 1) -> Iterator[pa.RecordBatch]:
    """One task's partial sketches: per block, the buckets hit and whether more than once, for each ``FLUSH`` values or so."""
    parts: list[np.ndarray] = []
    held = 0
    for v in values:
        parts.append(v)
        held += len(v)
        if held >= FLUSH:
            yield from _packed(np.concatenate(parts), bits, rows)
            parts, held = [], 0
    if held:
        yield from _packed(np.concatenate(parts), bits, rows)


def _packed(every: np.ndarray, bits: int, rows: int) -> Iterator[pa.RecordBatch]:
    width = 1 << min(_BLOCK_BITS, bits)
    for row in range(rows):
        ids, n = np.unique(buckets(every, bits, row), return_counts=True)
        edges = np.searchsorted(ids, np.arange(0, (1 << bits) + 1, width, dtype=np.int64))
        blocks = np.flatnonzero(np.diff(edges))
        datas = [_packed_ids(ids[edges[k] : edges[k + 1]] & np.uint32(width - 1), n[edges[k] : edges[k + 1]] > 1) for k in blocks]
        yield _batch([int(k) + (row << bits) // width for k in blocks], datas)


def packed_counts(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One task's partial sketch: per block, one 32-bit counter per bucket."""
    width = min(1 << _BLOCK_BITS, len(total))
    blocks = [b for b in range(len(total) // width) if total[b * width : (b + 1) * width].any()]
    yield _batch(blocks, [zlib.compress(total[b * width : (b + 1) * width].tobytes(), 1) for b in blocks])


def _batch(blocks: list[int], datas: list[bytes]) -> pa.RecordBatch:
    part = TaskContext.get().partitionId()
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([part] * len(blocks), pa.int32()), pa.array(datas, pa.binary())], ["block", "part", "data"])


def _merged(partial: DataFrame, one: Callable[[list[bytes]], bytes]) -> DataFrame:
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [pdf["part"].iloc[0] // FAN_IN], "data": [one(list(pdf["data"]))]})

    parts = partial.rdd.getNumPartitions()
    while True:
        partial = partial.groupBy("block", F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, PARTIAL)
        if parts <= FAN_IN:
            return partial
        parts = -(-parts // FAN_IN)


def counted(partial: DataFrame, bits: int) -> np.ndarray:
    """The merged counters (4 bytes each, saturating)."""

    def one(datas: list[bytes]) -> bytes:
        total = sum(np.frombuffer(zlib.decompress(d), np.uint32).astype(np.uint64) for d in datas)
        return zlib.compress(np.minimum(total, np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes(), 1)

    out = np.zeros(1 << bits, np.uint32)
    width = 1 << min(_BLOCK_BITS, bits)
    for r in _merged(partial, one).toLocalIterator():
        out[r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(zlib.decompress(r["data"]), np.uint32)
    return out


def repeated(partial: DataFrame, bits: int, rows: int = 1) -> np.ndarray:
    """The merged bits, packed by eight, for ``rows`` hash functions of ``2**bits`` buckets each."""
    width = 1 << min(_BLOCK_BITS, bits)

    def one(datas: list[bytes]) -> bytes:
        n = np.zeros(width, np.int64)
        for d in datas:
            ids, twice = _unpacked_ids(d)
            n[ids] += twice + np.int64(1)
        ids = np.flatnonzero(n)
        return _packed_ids(ids, n[ids] > 1)

    def bit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            datas = []
            for d in pdf["data"]:
                ids, twice = _unpacked_ids(d)
                flags = np.zeros(width, np.uint8)
                flags[ids[twice == 1]] = 1
                datas.append(np.packbits(flags, bitorder="little").tobytes())
            yield pd.DataFrame({"block": pdf["block"], "part": pdf["part"], "data": datas})

    out = np.zeros((rows << bits) // 8 or 1, np.uint8)
    for r in _merged(partial, one).mapInPandas(bit, PARTIAL).toLocalIterator():
        out[r["block"] * width // 8 : (r["block"] + 1) * width // 8] = np.frombuffer(r["data"], np.uint8)
    return out


def marked(keys: DataFrame) -> tuple[np.ndarray, int]:
    """(bits, their number as a power of two) of a sketch in which ``may_repeat`` finds each of ``keys`` (one column of 64-bit
    values): 16 bits a key, up to 2 ** 28 (32 MB); fuller ones let others through as well, so an exact join must follow."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from partial_repeated((np.repeat(b.column(0).to_numpy().view(np.uint64), 2) for b in batches), bits)

    keys = written(keys, "keys")
    bits = min(28, max(12, (16 * keys.count()).bit_length()))
    return repeated(keys.mapInArrow(mark, PARTIAL), bits), bits


def split_by(rows: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose ``key`` (64 bits) may be one of ``keys``, and those whose key surely is none. Where few
    are meant, a join with ``keys`` then has to move few rows."""
    bits, size = marked(keys)
    seen = rows.sparkSession.sparkContext.broadcast(bits)  # 32 MB at most
    at = rows.columns.index(key)

    def side(maybe: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(may_repeat(seen.value, batch.column(at).to_numpy().view(np.uint64), size) == maybe))

        return rows.mapInArrow(run, rows.schema)

    return side(True), side(False)


def may_repeat(sketch: np.ndarray, values: np.ndarray, bits: int, rows: int = 1) -> np.ndarray:
    """False where a value surely occurs once."""
    found = np.ones(len(values), bool)
    for row in range(rows):
        ids = buckets(values, bits, row).astype(np.int64) + (row << bits)
        found &= (sketch[ids >> 3] >> (ids & 7).astype(np.uint8)) & 1 == 1
    return found
