"""Numpy kernels over the raw UTF-8 buffer of an Arrow text column.

Every kernel sees a *slice*: some whole texts laid end to end in one uint8 array, with
``off[i]:off[i + 1]`` the bytes of text i. Slices are kept to about 1 MB so that the 8-byte
temporaries of a worker stay small; a text longer than that is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
_MULT, _INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_BYTE_KEYS = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_powers: dict[str, np.ndarray] = {}
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20


def small_batches(spark) -> None:
    """Have Spark hand texts to Python in batches of at most 2,000 rows and about 4 MB: both sides of the pipe hold whole batches.

    Plans read the limits when they run, so they stay with the session; smaller limits of its own are left as they are.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores in front as set them apart from these columns (whatever the case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def fixed_binary(rows: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
    """One binary value per row of a C-contiguous matrix, over its own memory."""
    n, width = len(rows), rows.shape[1] * rows.itemsize
    off = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    valid = None if mask is None else pa.py_buffer(np.packbits(~mask, bitorder="little"))
    return pa.Array.from_buffers(pa.binary(), n, [valid, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(rows))])


def binary_rows(column: pa.Array, dtype, width: int) -> np.ndarray:
    """The matrix behind a binary column without nulls whose values all hold `width` numbers."""
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    size = np.dtype(dtype).itemsize * width * len(column)
    return np.frombuffer(column.buffers()[2], np.uint8)[first : first + size].view(dtype).reshape(-1, width) if len(column) else np.zeros((0, width), dtype)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, last row + 1, bytes, offsets from 0) of an Arrow batch; a null text counts as empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = texts.buffers()
    n = len(texts)
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def _power_row(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the multiplier and of its inverse, modulo 2^64; those of a slice are kept, those of a longer text are not."""
    if n > 2 * SLICE_BYTES:
        return _power_row(_MULT, n), _power_row(_INV, n)
    if n > len(_powers.get("p", ())):
        size = 1 << max(16, (n - 1).bit_length())
        _powers["p"], _powers["i"] = _power_row(_MULT, size), _power_row(_INV, size)
    return _powers["p"][:n], _powers["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] a polynomial hash of bytes i..j, still scaled by the power at i."""
    p, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE_KEYS[buf] * p[: len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span; equal spans have equal hashes wherever they stand."""
    _, inverse = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start])


def word_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each run of bytes outside ASCII white space, and the index of the first word of each text (n + 1 entries)."""
    n = len(buf)
    inside = ~WHITE[buf]
    edge = np.ones(n + 1, bool)
    edge[1:n] = ~inside[:-1]
    cut = off[(off > 0) & (off < n)]
    edge[cut] = True
    starts = np.flatnonzero(inside & edge[:n])
    last = np.ones(n, bool)
    last[:-1] = ~inside[1:]
    last[cut - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, off)


def runs(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position within owner) of every element of groups of these lengths."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return owner, np.arange(len(owner)) - first[owner]


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sum of each group values[off[i]:off[i + 1]]; 0 for an empty group."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def seen_before(keys: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to an earlier key of its group, equal to any other key of its group)."""
    salted = mix(keys + group.astype(np.uint64) * U64(0xA0761D6478BD642F))
    order = np.argsort(salted, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = salted[order][1:] == salted[order][:-1]
    earlier, both = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    earlier[order] = same
    same[:-1] |= same[1:]
    both[order] = same
    return earlier, both


def shingle_sets(buf: np.ndarray, off: np.ndarray, words: int, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word shingles of each text, ascending, and the offsets of the texts' sets.

    A text of fewer words has its whole word sequence as the only shingle; a text without words has none.
    """
    if fold:
        buf = LOWER[buf]
    starts, ends, first = word_spans(buf, off)
    counts = np.diff(first)
    h = span_hash(prefix_hash(buf), starts, ends)
    n = np.where(counts >= words, counts - words + 1, (counts > 0).astype(np.int64))
    owner, at = runs(n)
    base = first[:-1][owner] + at
    short = (counts < words)[owner]
    acc = np.zeros(len(owner), np.uint64)
    for j in range(words):
        use = ~short | (j < counts[owner])
        idx = np.minimum(base + j, max(len(h) - 1, 0))
        acc = np.where(use, mix(acc * U64(0x9FB21C651E98DF25) + h[idx]), acc) if len(h) else acc
    acc = np.where(short, mix(acc + counts[owner].astype(np.uint64)), acc)
    edges = np.append(0, np.cumsum(n))
    for i in np.flatnonzero(n > 1):
        acc[edges[i] : edges[i + 1]].sort()
    new = np.ones(len(acc), bool)
    new[1:] = (acc[1:] != acc[:-1]) | (owner[1:] != owner[:-1])
    acc, owner = acc[new], owner[new]
    return acc, np.searchsorted(owner, np.arange(len(off)))
