"""Best-fit packing of token pieces into fixed-length sequences.

A piece length is an integer up to the capacity, so the whole packing problem is a histogram of at most ``capacity``
counts, whatever the number of documents. The driver plans on that histogram: best-fit-decreasing first, as bin patterns
with multiplicities, then a swap-based local search on the underfull patterns (move, one-for-one, two-for-one and
one-for-two exchanges that raise the sum of squared fills, until bins empty). The executors then number the pieces of each
length and look their places up in the plan, which is broadcast and holds a few thousand rows at most.

Only lengths, not texts, are ever shuffled. The numbering is salted by a hash of the document id, so a length that a third
of all pieces share is spread over all partitions.

Defined results: a null text is an empty one and packs as the lone end-of-document id; a very long text is cut into pieces;
equal lengths are told apart by salt, id, piece and CRC; repeated rows are packed once per row; an empty table gives an empty result; only the named columns are read, so others cannot clash; a null id is kept.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .bpe import load
from .scratch import Scratch

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, ids array<int>, sequence_id long, offset long"


@dataclass
class Bins:
    """`count` bins that all hold the same lengths."""

    items: Counter
    count: int
    fill: int = field(init=False)

    def __post_init__(self):
        self.fill = sum(n * k for n, k in self.items.items())


def best_fit(histogram: dict[int, int], capacity: int) -> list[Bins]:
    """Best-fit-decreasing over a histogram of lengths: each pattern is opened by the longest length left."""
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left)
    out = []
    while lengths:
        space, items = capacity, Counter()
        at = len(lengths) - 1
        while at >= 0 and space:
            at = bisect.bisect_right(lengths, space, 0, at + 1) - 1
            if at < 0:
                break
            n = lengths[at]
            k = min(left[n], space // n)
            items[n] += k
            space -= n * k
            at -= 1
        times = min(left[n] // k for n, k in items.items())
        for n, k in items.items():
            left[n] -= k * times
            if not left[n]:
                lengths.pop(bisect.bisect_left(lengths, n))
        out.append(Bins(items, times))
    return out


def exchange(donor: Counter, taker: Counter, gap: int) -> tuple[list[int], list[int]] | None:
    """Lengths that go from donor to taker, and back, so that the taker grows by 1 to gap; the largest growth of the first kind that works."""
    d, t = sorted(donor), sorted(taker)
    fits = bisect.bisect_right(d, gap)
    if fits:
        return [d[fits - 1]], []
    best, found = 0, None
    for y in t:  # one for one
        i = bisect.bisect_right(d, y + gap) - 1
        if i >= 0 and d[i] - y > best:
            best, found = d[i] - y, ([d[i]], [y])
    if found:
        return found
    pairs = sorted({(a + b, a, b) for i, a in enumerate(d) for b in d[i:] if a != b or donor[a] > 1})
    for y in t:  # two for one
        i = bisect.bisect_right(pairs, (y + gap, 1 << 60, 0)) - 1
        if i >= 0 and pairs[i][0] - y > best:
            best, found = pairs[i][0] - y, (list(pairs[i][1:]), [y])
    if found:
        return found
    for i, a in enumerate(t):  # one for two
        for b in t[i:]:
            if a != b or taker[a] > 1:
                j = bisect.bisect_right(d, a + b + gap) - 1
                if j >= 0 and d[j] - a - b > best:
                    best, found = d[j] - a - b, ([d[j]], [a, b])
    return found


def local_search(bins: list[Bins], capacity: int, rounds: int = 4000) -> list[Bins]:
    """Exchanges between underfull bins, from the emptiest on; every step raises the sum of squared fills.

    Ends where no exchange is left, where the number of bins meets its lower bound, or after `rounds` exchanges of whole
    patterns: an effort bound, which depends on the lengths that occur and not on the number of documents. All pieces are placed.
    """
    full = [b for b in bins if b.fill == capacity]
    open_ = [b for b in bins if b.fill < capacity]
    least = -(-sum(b.fill * b.count for b in bins) // capacity)
    dead: set[tuple] = set()
    for _ in range(rounds):
        if sum(b.count for b in full) + sum(b.count for b in open_) <= least:
            break
        open_.sort(key=lambda b: b.fill)
        step = None
        for i, donor in enumerate(open_):
            for taker in reversed(open_[i:]):
                if taker is donor and donor.count < 2:
                    continue
                key = (tuple(sorted(donor.items.items())), tuple(sorted(taker.items.items())))
                if key in dead:
                    continue
                got = exchange(donor.items, taker.items, capacity - taker.fill)
                if got:
                    step = donor, taker, got
                    break
                dead.add(key)
            if step:
                break
        if not step:
            break
        donor, taker, (give, take) = step
        k = donor.count // 2 if donor is taker else min(donor.count, taker.count)
        less, more = Counter(donor.items), Counter(taker.items)
        less.subtract(give)
        less.update(take)
        more.subtract(take)
        more.update(give)
        donor.count -= k
        taker.count -= k
        for items in (+less, +more):
            if items:
                b = Bins(items, k)
                (full if b.fill == capacity else open_).append(b)
        open_ = [b for b in open_ if b.count]
    return full + open_


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first bin, times in a bin, offset in the bin), ordered by length and rank; and the number of bins."""
    rows, base = [], 0
    used: Counter = Counter()
    for b in local_search(best_fit(histogram, capacity), capacity):
        offset = 0
        for n in sorted(b.items, reverse=True):
            k = b.items[n]
            rows.append((n, used[n], base, k, offset))
            used[n] += k * b.count
            offset += n * k
        base += b.count
    return np.array(sorted(rows), np.int64).reshape(-1, 5), base


_encoders: dict[str, object] = {}


def ranked_encoder(ranks_path: str, pattern: str):
    """The byte-level vocabulary as ranks; one encoder per Python worker."""
    if ranks_path not in _encoders:
        import base64

        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[ranks_path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[ranks_path]


def token_pieces(docs: DataFrame, ranks_path: str, tokenizer_path: str, pattern: str, special: dict[str, int], capacity: int, end_id: int, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most `capacity` ids of every document: its ids, then end_id; only the first piece of a cut one may be shorter.

    `special` strings in a text become their ids, as the vocabulary's own tokenizer file has it. The encoder of ranks gives the
    ids of that tokenizer faster; where its pattern engine gives up (a million white-space characters in a row), the tokenizer runs.
    """

    K.small_batches(docs.sparkSession)

    def encode(text: str) -> np.ndarray:
        enc = ranked_encoder(ranks_path, pattern)

        def ids(part: str) -> np.ndarray:
            try:
                return enc.encode_to_numpy(part, disallowed_special=()).astype(np.uint32)
            except ValueError:
                return np.array(load(tokenizer_path).encode(part, add_special_tokens=False).ids, np.uint32)

        parts = [text]
        for mark, number in special.items():
            if mark in text:
                parts = [y for x in parts for y in ([x] if not isinstance(x, str) else [z for w in x.split(mark) for z in (w, number)][:-1])]
        out = [np.array([x], np.uint32) if isinstance(x, int) else ids(x) for x in parts]
        return np.concatenate([*out, np.array([end_id], np.uint32)])

    def pieces(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            owner, piece, start, length, crc, kept = [], [], [], [], [], []

            def flush():
                got = pa.RecordBatch.from_arrays([ids.take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(kept, pa.list_(pa.int32()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])  # noqa: B023
                for x in (owner, piece, start, length, crc, kept):  # noqa: B023
                    x.clear()
                return got

            for i in range(batch.num_rows):
                tokens = encode(texts[i].as_py())
                at = 0
                head = len(tokens) % capacity or capacity
                for j in range(-(-len(tokens) // capacity)):
                    end = head + j * capacity
                    part = tokens[at:end]
                    owner.append(i)
                    piece.append(j)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(part.tobytes()))
                    kept.append(part.astype(np.int32) if keep_ids else None)
                    at = end
                if len(owner) > 4000:
                    yield flush()
            yield flush()

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(pieces, PIECES)


def pack(pieces: DataFrame, capacity: int, salts: int | None = None) -> DataFrame:
    """Place every piece (doc_id, piece, start, length, ids_crc32, ids): adds sequence_id and its gapless offset there."""
    spark = pieces.sparkSession
    scratch = Scratch(spark, "pack")
    saved = scratch.save(pieces)
    parts = salts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    short = saved.where(F.col("length") < capacity).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int"))
    counts = scratch.save(short.groupBy("length", "salt").count().coalesce(1))
    table, bins = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    by_length = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("count").over(by_length), F.lit(0)).alias("base"))
    ranked = short.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))).join(bases, ["length", "salt"])
    places = spark.sparkContext.broadcast(table)

    def place(batches):
        rows = places.value
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for batch in batches:
            n = batch.column(3).to_numpy()
            rank = batch.column(6).to_numpy()
            at = np.searchsorted(keys, (n << 44) + rank, "right") - 1
            nth = rank - rows[at, 1] if len(rows) else rank
            seq, off = rows[at, 2] + nth // rows[at, 3], rows[at, 4] + nth % rows[at, 3] * n
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(seq), pa.array(off)], names=[*batch.schema.names[:6], "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    placed = ranked.select(*kept, (F.col("base") + F.col("rank") - 1).alias("rank")).mapInArrow(place, PLACED)
    whole = saved.where(F.col("length") >= capacity).select(*kept, (F.lit(bins) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(whole)
