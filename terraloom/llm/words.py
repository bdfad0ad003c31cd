"""Vectorised handling of many texts at once inside one task.

All functions take the bytes of an Arrow string column and work on whole batches, so a
task costs a few numpy passes over its bytes and nothing per word in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
NULL_ID = np.iinfo(np.int64).max  # a missing id sorts after every other


def give_back() -> None:
    """Return freed memory to the machine; workers are reused and would else keep the most they ever had."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A task over batches that gives memory back after each batch of results and at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for k, made in enumerate(task(batches)):
                yield made
                if k % 4 == 3:
                    give_back()
        finally:
            give_back()

    return run


def tidied(task: Callable[..., pa.Table], *args) -> pa.Table:
    """Result of a task over one group, with memory given back."""
    out = task(*args)
    give_back()
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = np.atleast_1d(x)
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
BASE = 0xD6E8FEB86659FD93
INVERSE = pow(BASE, -1, 1 << 64)
_tables: dict[int, np.ndarray] = {}


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept per worker."""
    p = _tables.get(base, np.ones(1, U))
    while len(p) < n:
        p = np.concatenate([p, p * U(pow(base, len(p), 1 << 64))])
    _tables[base] = p
    return p[:n]


def column_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = texts.fill_null("").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data, off - off[0]


def text_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The inverse of ``column_bytes``."""
    return pa.Array.from_buffers(
        pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    ).cast(pa.string())


def ids_column(ids: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(ids.fill_null(NULL_ID).to_numpy(), np.int64)


def spaces(data: np.ndarray) -> np.ndarray:
    """True for the bytes 09-0D and 20."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word (run of other bytes than ``spaces``) in text order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    full = ~spaces(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = full.copy(), full.copy()
    first[1:] &= ~full[:-1] | edge[1:-1]
    last[:-1] &= ~full[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row of the text that each word lies in."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = 1 << 19) -> np.ndarray:
    """64-bit hash of each byte span (running polynomial); spans are in order and apart.

    Works through blocks of about ``block`` bytes that end between spans.
    """
    out = np.zeros(len(starts), U)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + block, side="right")))
        first, last = starts[a:b] - starts[a], ends[a:b] - starts[a]
        n = int(last[-1])
        run = np.zeros(n + 1, U)
        np.cumsum(_BYTE[data[starts[a] : starts[a] + n]] * powers(n), out=run[1:])
        out[a:b] = (run[last] - run[first]) * powers(n, INVERSE)[first] + (last - first).astype(U)
        a = b
    return mix(out)


def window_hash(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes; entry i covers i..i+k-1."""
    n = max(0, len(h) - k + 1)
    out = np.zeros(n, U)
    for j, m in enumerate(mix(np.arange(1, k + 1, dtype=U) + U(1000 * seed + 17)) | U(1)):
        out += h[j : j + n] * m
    return mix(out)


def planes(x: np.ndarray) -> bytes:
    """Integers as byte planes: the empty high planes vanish when the shuffle compresses."""
    return np.ascontiguousarray(np.asarray(x).view(U)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unplanes(raw: bytes, dtype=U) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).reshape(-1).view(dtype)


def sorted_planes(x: np.ndarray) -> bytes:
    """``planes`` of the differences of a sorted array."""
    return planes(np.diff(x, prepend=U(0)))


def unsorted_planes(raw: bytes) -> np.ndarray:
    return np.cumsum(unplanes(raw), dtype=U)


def firsts(sorted_keys: np.ndarray) -> np.ndarray:
    """Index of the first entry of each run of equal keys."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.flatnonzero(new)


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of a whole text column; sizes the number of groups, one pruned scan."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("b")).first()["b"])


def unlike(keep, results) -> None:
    """Refuse columns to pass on that are named like a result (in any case, as Spark compares names)."""
    same = {c.lower() for c in keep} & set(results)
    if same:
        raise ValueError(f"rename the columns to keep that are named like a result: {sorted(same)}")
