"""Hashed n-gram text features and calibrated logistic regression, trained on the driver on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

WORD_BUCKETS = CHAR_BUCKETS = 1 << 16
BUCKETS = WORD_BUCKETS + CHAR_BUCKETS
CHARS = 4
U64 = np.uint64


def ngrams(buf: np.ndarray, off: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Buckets of the word unigrams and bigrams, and of the character n-grams (4 bytes), each with the texts' offsets."""
    prefix = K.prefix_hash(buf)
    starts, ends, first = K.word_spans(buf, off)
    h = K.span_hash(prefix, starts, ends)
    pair = np.append(K.mix(h[:-1] * U64(3) + h[1:]), h[-1:]) if len(h) else h  # the last word of a text meets the next text's first: mended below
    pair[:-1][h[:-1] == h[1:]] = U64(7)  # a word repeated at once is one feature, whatever the word
    last = first[1:][np.diff(first) > 0] - 1
    pair[last] = h[last]
    words = np.empty(2 * len(h), np.int32)
    words[0::2] = h & U64(WORD_BUCKETS - 1)
    words[1::2] = pair & U64(WORD_BUCKETS - 1)
    sizes = np.maximum(np.diff(off) - CHARS + 1, 0)
    wide = np.zeros(len(buf) + CHARS, np.uint32)
    for j in range(CHARS):
        wide[: max(len(buf) - j, 0)] |= buf[j:].astype(np.uint32) << np.uint32(8 * j)
    wide *= np.uint32(0x9E3779B1)
    keep = np.ones(len(buf), bool)
    for j in range(1, CHARS):
        keep[np.maximum(off[1:] - j, off[:-1])[np.diff(off) >= j]] = False
    chars = (wide[: len(buf)][keep] >> np.uint32(16)).astype(np.int32) + WORD_BUCKETS
    return (words, 2 * first), (chars, np.append(0, np.cumsum(sizes)))


def scores(buf: np.ndarray, off: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Logit of each text: bias plus the mean weight of its word n-grams plus that of its character n-grams."""
    out = np.full(len(off) - 1, bias)
    for idx, at in ngrams(buf, off):
        out += K.sums(weights[idx].astype(np.float64), at) / np.maximum(np.diff(at), 1)
    return out


def sparse_rows(buf: np.ndarray, off: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, mean count) of each text, as int32 and float32."""
    (w, wo), (c, co) = ngrams(buf, off)
    out = []
    for i in range(len(off) - 1):
        parts = []
        for x in (w[wo[i] : wo[i + 1]], c[co[i] : co[i + 1]]):
            idx, n = np.unique(x, return_counts=True)
            parts.append((idx.astype(np.int32), (n / max(len(x), 1)).astype(np.float32)))
        out.append((np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))
    return out


@dataclass
class Rows:
    """Training rows in compressed form; a driver-side object of bounded size. Row i has places at[i] to at[i + 1]."""

    index: np.ndarray
    value: np.ndarray
    at: np.ndarray

    @property
    def n(self) -> int:
        return len(self.at) - 1

    @staticmethod
    def of(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        index = np.concatenate([np.zeros(0, np.int32), *(i for i, _ in pairs)])
        value = np.concatenate([np.zeros(0, np.float32), *(v for _, v in pairs)])
        return Rows(index, value, np.append(0, np.cumsum([len(i) for i, _ in pairs])).astype(np.int64))

    def joined(self, other: Rows) -> Rows:
        return Rows(np.concatenate([self.index, other.index]), np.concatenate([self.value, other.value]), np.concatenate([self.at, self.at[-1] + other.at[1:]]))

    def _chunks(self, size: int = 1 << 18):
        """(first row, last row + 1, sizes, index, value) of some whole rows at a time."""
        lo = 0
        while lo < self.n:
            hi = max(lo + 1, int(np.searchsorted(self.at, self.at[lo] + size, "right")) - 1)
            a, b = self.at[lo], self.at[hi]
            yield lo, hi, np.diff(self.at[lo : hi + 1]), self.index[a:b], self.value[a:b]
            lo = hi

    def dot(self, weights: np.ndarray) -> np.ndarray:
        out, weights = np.zeros(self.n), weights.astype(np.float32)
        for lo, hi, sizes, index, value in self._chunks():
            some = np.flatnonzero(sizes)
            if len(some):
                out[lo + some] = np.add.reduceat(weights[index] * value, (np.cumsum(sizes) - sizes)[some], dtype=np.float64)
        return out


class Columns:
    """The same rows ordered by bucket: both products then touch short arrays at random and long ones in order."""

    def __init__(self, rows: Rows):
        order = np.argsort(rows.index, kind="stable")
        self.n = rows.n
        self.row = np.repeat(np.arange(rows.n, dtype=np.int16 if rows.n < 1 << 15 else np.int32), np.diff(rows.at))[order]
        self.value = rows.value[order]
        index = rows.index[order]
        del order
        self.first = np.flatnonzero(np.append(True, index[1:] != index[:-1])[: len(index)])
        self.bucket = index[self.first]
        self.sizes = np.diff(np.append(self.first, len(index)))

    def _chunks(self, size: int = 1 << 18):
        """(first column, last column + 1, first place, last place + 1) of some whole columns at a time."""
        ends, lo = np.cumsum(self.sizes), 0
        while lo < len(self.bucket):
            hi = max(lo + 1, int(np.searchsorted(ends, self.first[lo] + size, "right")))
            yield lo, hi, int(self.first[lo]), int(ends[hi - 1])
            lo = hi

    def dot(self, weights: np.ndarray) -> np.ndarray:
        out, own = np.zeros(self.n), weights[self.bucket]
        for lo, hi, a, b in self._chunks():
            out += np.bincount(self.row[a:b], np.repeat(own[lo:hi], self.sizes[lo:hi]) * self.value[a:b], self.n)
        return out

    def pull(self, error: np.ndarray, buckets: int) -> np.ndarray:
        out = np.zeros(buckets)
        for lo, hi, a, b in self._chunks():
            out[self.bucket[lo:hi]] = np.add.reduceat(error[self.row[a:b]] * self.value[a:b], self.first[lo:hi] - a)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(rows: Rows | Columns, y: np.ndarray, buckets: int, use: np.ndarray, steps: int = 80, rate: float = 1.0, decay: float = 1e-5, start: tuple | None = None) -> tuple[np.ndarray, float]:
    """Class-balanced logistic regression by full-batch Adam, on the rows where `use` holds."""
    rows = Columns(rows)
    w, b = (start[0].copy(), start[1]) if start else (np.zeros(buckets), 0.0)
    m, v, mb, vb = np.zeros(buckets), np.zeros(buckets), 0.0, 0.0
    share = use * np.where(y == 1, 0.5 / max((use & (y == 1)).sum(), 1), 0.5 / max((use & (y != 1)).sum(), 1))
    for t in range(1, steps + 1):
        error = (sigmoid(rows.dot(w) + b) - (y == 1)) * share
        g = rows.pull(error, buckets) + decay * w / max(int(use.sum()), 1)
        gb = float(error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= 0.1 * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the sigmoid that maps logits to probabilities (Newton steps, smoothed targets)."""
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(np.abs(logit).mean()), 1e-6) if len(logit) else 1.0
    x = logit / scale
    a, c = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * x + c)
        e, s = p - target, p * (1 - p) + 1e-9
        ga, gc = float((e * x).sum()) + 1e-3 * (a - 1), float(e.sum())
        haa, hac, hcc = float((s * x * x).sum()) + 1e-3, float((s * x).sum()), float(s.sum()) + 1e-6
        det = haa * hcc - hac * hac
        if det <= 0:
            break
        da, dc = (hcc * ga - hac * gc) / det, (haa * gc - hac * ga) / det
        a, c = a - np.clip(da, -2, 2), c - np.clip(dc, -2, 2)
        if abs(da) + abs(dc) < 1e-7:
            break
    return float(max(a, 1e-3) / scale), float(c)


def sample_labels(labels: DataFrame, id_col: str, label_col: str, limit: int) -> DataFrame:
    """At most `limit` labelled ids, the lowest by hash; nulls and ids labelled both ways are left out."""
    clean = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("__id")).agg(F.min(label_col).alias("__y"), F.max(label_col).alias("__z"))
    return clean.where("__y = __z").select("__id", F.col("__y").cast("int").alias("__y")).orderBy(F.xxhash64("__id", F.lit(17)), "__id").limit(limit)


@dataclass
class Sample:
    """Labelled rows on the driver, by ascending id: label, extra columns as text, features."""

    ids: np.ndarray
    y: np.ndarray
    extra: list[list]
    rows: Rows


def fetch_rows(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, extra: list[str] = []) -> Sample:  # noqa: B006
    """The documents of ids(__id, __y) with their features; of several rows of one id the least (by columns, then features) is taken.

    `ids` has at most the documented sample bound of rows, so its broadcast and what the driver receives are bounded. The
    features come as Arrow batches, each copied into arrays of the right size and let go.
    """
    K.small_batches(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("long").alias("__id"), *(F.col(c).cast("string").alias(f"__x{i}") for i, c in enumerate(extra)), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    chosen = chosen.join(F.broadcast(ids.withColumn("__id", F.col("__id").cast("long"))), "__id")
    chosen = chosen.select("__id", "__y", *(f"__x{i}" for i in range(len(extra))), "__text")
    schema = "__id long, __y int, " + "".join(f"__x{i} string, " for i in range(len(extra))) + "idx binary, val binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def features(batches):
        for batch in batches:
            at = batch.schema.get_field_index("__text")
            for lo, hi, buf, off in K.text_slices(batch, "__text"):
                rows = sparse_rows(buf, off)
                cols = [batch.column(i).slice(lo, hi - lo) for i in range(at)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([i.tobytes() for i, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())], names=names)

    got = chosen.mapInArrow(features, schema).groupBy("__id", "__y").agg(F.min(F.struct(*names[2:])).alias("__r")).select("__id", "__y", "__r.*").toArrow()
    size = lambda c: pc.binary_length(got.column(c)).to_numpy().astype(np.int64) // 4
    lengths = size("idx")
    order = np.argsort(got.column("__id").to_numpy(), kind="stable")
    at = np.append(0, np.cumsum(lengths[order]))
    place = np.empty(len(order), np.int64)
    place[order] = at[:-1]
    rows = Rows(np.empty(at[-1], np.int32), np.empty(at[-1], np.float32), at)
    out = Sample(got.column("__id").to_numpy()[order], got.column("__y").to_numpy()[order], [[x[i] for i in order] for x in (got.column(f"__x{j}").to_pylist() for j in range(len(extra)))], rows)
    batches, row = got.select(["idx", "val"]).to_batches(), 0
    del got
    while batches:
        batch = batches.pop(0)
        for i in range(batch.num_rows):
            a, n = place[row], lengths[row]
            rows.index[a : a + n] = np.frombuffer(batch.column(0)[i].as_buffer(), np.int32)
            rows.value[a : a + n] = np.frombuffer(batch.column(1)[i].as_buffer(), np.float32)
            row += 1
    pa.default_memory_pool().release_unused()
    return out
