"""Columns of numbers that move between tasks as packed blocks: far smaller and faster than one row a number.

A task deals its numbers to buckets by a hash of their key, packs each bucket's part, and the parts of a bucket meet in
one task.  Keys are aggregated before they are packed, so a very common one counts once a block; buckets are made as
many as keep the numbers of one in memory (`buckets`), however much data there is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: Numbers of a bucket, about.
BUCKET = 1_000_000

_PACK = zstandard.ZstdCompressor(level=1)
_UNPACK = zstandard.ZstdDecompressor()
SCHEMA = "bucket int, side int, pack binary"


def buckets(numbers: int) -> int:
    return max(8, -(-numbers // BUCKET))


def pack(columns: list[np.ndarray]) -> bytes:
    """Columns of eight-byte numbers, of one length, as bytes.

    The first one is kept as differences, by bytes of equal weight: in order, most of these are 0.  So are later ones of
    signed numbers, as they are: counts and numbers of rows, few of whose bytes differ.
    """
    first = np.ascontiguousarray(columns[0]).view(np.uint64)
    rest = (_weights(c) if c.dtype == np.int64 else np.ascontiguousarray(c).tobytes() for c in columns[1:])
    return _PACK.compress(b"".join([_weights(np.diff(first, prepend=np.uint64(0))), *rest]))


def _weights(numbers: np.ndarray) -> bytes:
    return np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes()


def _numbers(data: bytes, n: int, kind: type, i: int) -> np.ndarray:
    weights = np.frombuffer(data, dtype=np.uint8, count=8 * n, offset=8 * n * i).reshape(8, n).T
    return np.ascontiguousarray(weights).view(kind)[:, 0]


def unpack(raw: bytes, kinds: tuple) -> list[np.ndarray]:
    data = _UNPACK.decompress(raw)
    n = len(data) // (8 * len(kinds))
    first = np.cumsum(_numbers(data, n, np.uint64, 0), dtype=np.uint64).view(kinds[0])
    rest = (_numbers(data, n, k, i) if k is np.int64 else np.frombuffer(data, dtype=k, count=n, offset=8 * n * i) for i, k in enumerate(kinds[1:], 1))
    return [first, *rest]


def bucket_of(key: np.ndarray, many: int) -> np.ndarray:
    """The bucket of 64-bit hashes; ascending keys have ascending buckets."""
    return ((key >> np.uint64(32)) * np.uint64(many) >> np.uint64(32)).astype(np.int64)


def dealt(key: np.ndarray, columns: list[np.ndarray], many: int, side: int = 0) -> pa.RecordBatch:
    """A row for each bucket that the hashes `key` fall into, with its part of the columns, by their first one in order.

    Numbers that stand in order pack well, so the first column should be the one that repeats most.
    """
    order = np.argsort(columns[0])
    b = bucket_of(key[order], many)
    by = np.argsort(b.astype(np.uint16) if many <= 1 << 16 else b, kind="stable")
    order, b = order[by], b[by]
    return _cut(b, [c[order] for c in columns], side)


def in_order(key: np.ndarray, columns: list[np.ndarray], many: int, side: int = 0) -> pa.RecordBatch:
    """`dealt` by ascending hashes, which are the first column, before `columns`.

    A step between neighbours takes as many bytes in many buckets as in few, since a bucket is a range of hashes.
    """
    return _cut(bucket_of(key, many), [key, *columns], side)


def _cut(b: np.ndarray, columns: list[np.ndarray], side: int) -> pa.RecordBatch:
    """A row for each of the ascending buckets b."""
    cut = np.flatnonzero(np.diff(b, prepend=-1)).tolist() + [len(b)]
    parts = [pack([c[lo:hi] for c in columns]) for lo, hi in zip(cut, cut[1:], strict=False)]
    which = b[cut[:-1]].astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(which), pa.array(np.full(len(which), side, np.int32)), pa.array(parts, pa.binary())], ["bucket", "side", "pack"])


def gathered(parts: DataFrame, meet: Callable[[dict[int, list[bytes]]], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Call `meet` with the packs of each bucket, by side; the packs of one bucket are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        last = None
        for batch in batches:
            for b, side, raw in zip(batch.column("bucket").to_pylist(), batch.column("side").to_pylist(), batch.column("pack"), strict=True):
                if b != last and held:
                    yield from _some(meet(held))
                    held = {}
                last = b
                held.setdefault(side, []).append(raw.as_py())
        if held:
            yield from _some(meet(held))

    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _some(batch: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
    if batch is not None and batch.num_rows:
        yield batch


def columns(packs: list[bytes], kinds: tuple) -> list[np.ndarray]:
    """The columns of several packs, one after the other."""
    parts = [unpack(p, kinds) for p in packs]
    return [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, k) for k in kinds]


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in ascending order of keys, and the sum of n over it."""
    order = np.argsort(key)
    s = key[order]
    at = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.zeros(0, np.int64)
    return order[at], (np.add.reduceat(n[order], at) if len(at) else n[:0])
