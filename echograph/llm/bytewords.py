"""Words of many texts as numpy arrays: where they start and end, and 64-bit hashes, without a
Python object for each word. Separators are ASCII, so UTF-8 bytes can be looked at one by one."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def _table(kind: str) -> bytes:
    """Bytes to bytes: separators become spaces, A-Z lower case where the kind folds."""
    out = bytearray(range(256))
    for b in range(128):
        if kind == "space":
            separates = b == 0x20 or 0x09 <= b <= 0x0D
        else:
            separates = not chr(b).isalnum()
        out[b] = 0x20 if separates else (b + 32 if kind != "space" and 65 <= b <= 90 else b)
    return bytes(out)


TABLES = {"space": _table("space"), "alnum": _table("alnum")}


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_power_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    have = _power_cache.get(seed)
    if have is None or len(have[0]) < n:
        base = (_MULTIPLIER * (2 * seed + 1)) % 2**64 | 1
        size = max(n, 1 << 20)
        have = _powers(size, base), _powers(size, pow(base, -1, 2**64))
        if size <= 1 << 21:
            _power_cache[seed] = have
    return have[0][:n], have[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finish that spreads every bit."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of ``texts``: ``start`` and ``end`` in ``data``, and ``first[i]:first[i + 1]`` of text i."""

    def __init__(self, texts: list[str], kind: str):
        raw = [t.encode() for t in texts]
        self.data = b"\n".join(raw).translate(TABLES[kind])
        self.bytes = np.frombuffer(self.data, np.uint8)
        edges = np.flatnonzero(np.diff((self.bytes != 0x20).view(np.int8), prepend=0, append=0))
        self.start, self.end = edges[0::2], edges[1::2]
        at = np.cumsum([0, *(len(r) + 1 for r in raw)])
        self.first = np.searchsorted(self.start, at)

    def hashes(self, seed: int) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial over random byte values, mixed."""
        values = np.random.default_rng(seed).integers(0, 2**64, 256, np.uint64)
        power, inverse = powers(len(self.bytes) + 1, seed)
        total = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(values[self.bytes] * power[:-1], out=total[1:])
        return mix((total[self.end] - total[self.start]) * inverse[self.start])


def window_hashes(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive word hashes."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    power, inverse = powers(n + 1, seed)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * power[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * inverse[: n - k + 1])


def as_long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def pack(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Binary values: the numbers from each of ``first`` up to the next."""
    offsets = (np.append(first, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def unpack(column: pa.Array, kind: type = np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, row of each) of binary values."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind), np.repeat(np.arange(len(values)), [len(v) // np.dtype(kind).itemsize for v in values])


def among(values: np.ndarray, row: np.ndarray, found: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Which values are among the found ones of their row, by binary search in all rows at once; ``of``
    ascends over n rows."""
    found = found[np.lexsort((found, of))]
    first = np.searchsorted(of, np.arange(n + 1))
    lo, hi = first[row], first[row + 1]
    end, last = hi, max(len(found) - 1, 0)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        less = (lo < hi) & (found[np.minimum(mid, last)] < values)
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
    return (lo < end) & (found[np.minimum(lo, last)] == values) if len(found) else np.zeros(len(values), bool)


def pack_rows(key: str, value: str, out: str, limit: int = 4096) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(key, out): long values of rows sorted by key packed, ``limit`` at most in one; those of a key may
    be in several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, v = batch.column(key).to_numpy(), batch.column(value).to_numpy()
            if len(k):
                new = np.concatenate([[True], k[1:] != k[:-1]])
                start = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
                first = np.flatnonzero((np.arange(len(k)) - start) % limit == 0)
                yield pa.RecordBatch.from_arrays([pa.array(k[first]), pack(v, first)], [key, out])

    return run
