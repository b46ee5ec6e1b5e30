"""Rateless set reconciliation: an endless stream of coded symbols, of which a prefix slightly larger than the difference decodes.

Follows the published construction: every element is in symbol 0, and in symbol i with probability 1 / (1 + i / 2); the next
index after i is i + ceil((i + 1.5) * (2^32 / sqrt(r + 1) - 1)) for a 64-bit random r of the element's own generator. The
symbols are linear, so a prefix is one grouped xor/sum, folded per partition before it is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..spec import TableSpec
from . import reconcile as R
from .decode import Decoded

U64 = np.uint64
SYMBOLS = "idx long, cnt long, fp_xor long, id_xor long, hash_xor long"


def symbol_hash(fp: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return H.sm64(H.sm64(np.asarray(fp, U64) + U64(H.CHECKSUM_SEED)) ^ np.asarray(ids, U64))


def indexes(hashes: np.ndarray, count: int):
    """Yield (rows, index of each) level by level: every index below `count` that the elements of these hashes are in."""
    rows, at, state = np.arange(len(hashes)), np.zeros(len(hashes), np.int64), hashes.copy()
    while len(rows):
        yield rows, at
        state = H.sm64(state + U64(H.RETRY_STEP))
        r = state.astype(np.float64)
        at = at + np.ceil((at + 1.5) * (2.0**32 / np.sqrt(r + 1.0) - 1.0)).clip(1, 1 << 50).astype(np.int64)
        keep = at < count
        rows, at, state = rows[keep], at[keep], state[keep]


def coded_symbols(rows: DataFrame, count: int, sign: str | None = None, shards: int = 1) -> DataFrame:
    """(idx, cnt, fp_xor, id_xor, hash_xor), and shard with shards > 1, of the first `count` symbols of rows(fp, id)."""

    def fold(batches):
        held = np.zeros((shards, 4, count), U64)
        for batch in batches:
            fp, ids, s = (batch.column(i).to_numpy() for i in range(3))
            fp, ids = fp.view(U64), ids.view(U64)
            h = symbol_hash(fp, ids)
            own = (h % U64(shards)).astype(np.int64)
            for which, at in indexes(h, count):
                np.add.at(held[:, 0].view(np.int64), (own[which], at), s[which])
                for k, v in ((1, fp), (2, ids), (3, h)):
                    np.bitwise_xor.at(held[:, k], (own[which], at), v[which])
        shard, idx = np.nonzero(held.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(idx), *(pa.array(held[shard, k, idx].view(np.int64)) for k in range(4))], names=["shard", "idx", "cnt", "fp_xor", "id_xor", "hash_xor"])

    parts = rows.select("fp", "id", (F.col(sign) if sign else F.lit(1)).cast("long").alias("s")).mapInArrow(fold, "shard int, " + SYMBOLS)
    got = parts.groupBy("shard", "idx").agg(F.sum("cnt").alias("cnt"), *(F.bit_xor(c).alias(c) for c in ("fp_xor", "id_xor", "hash_xor")))
    return got if shards > 1 else got.drop("shard")


def to_array(symbols: DataFrame, count: int) -> np.ndarray:
    out = np.zeros((4, count), U64)
    got = symbols.select("idx", "cnt", "fp_xor", "id_xor", "hash_xor").toArrow()
    at = got.column(0).to_numpy()
    for k in range(4):
        out[k, at] = got.column(k + 1).to_numpy().view(U64)
    return out


def decode(view: np.ndarray) -> Decoded:
    """Peel a difference prefix; complete when nothing is left in it."""
    work, out, seen = view.copy(), Decoded(), set()
    while True:
        counts = work[0].view(np.int64)
        pure = np.flatnonzero((np.abs(counts) == 1) & (work[3] == symbol_hash(work[1], work[2])))
        found = {(int(work[1, i]), int(work[2, i])): int(counts[i]) for i in pure}
        fresh = [(f, r, s) for (f, r), s in found.items() if (f, r, s) not in seen]
        if not fresh:
            break
        seen.update(fresh)
        fp, ids, sign = (np.array(c, t) for c, t in zip(zip(*fresh, strict=True), (U64, U64, np.int64), strict=True))
        h = symbol_hash(fp, ids)
        for which, at in indexes(h, work.shape[1]):
            np.subtract.at(work[0].view(np.int64), at, sign[which])
            for k, v in ((1, fp), (2, ids), (3, h)):
                np.bitwise_xor.at(work[k], at, v[which])
        out.plus += [(f, r) for f, r, s in fresh if s > 0]
        out.minus += [(f, r) for f, r, s in fresh if s < 0]
    out.residual = int(work.any(0).sum())
    return out


def reconcile_rateless(source: DataFrame, target: DataFrame, first: int = 64, cap: int = 1 << 20, growth: float = 2.0) -> tuple[Decoded, int]:
    """(decoded difference of rows(fp, id), symbols used): longer and longer prefixes until one decodes or `cap` is passed."""
    both = source.withColumn("sign", F.lit(1)).unionByName(target.withColumn("sign", F.lit(-1))).persist()
    try:
        count = first
        while True:
            got = decode(to_array(coded_symbols(both, count, "sign"), count))
            if got.complete or count >= cap:
                return got, count
            count = min(cap, int(count * growth))
    finally:
        both.unpersist()


def reconcile_tables(source: DataFrame, target: DataFrame, spec: TableSpec, **options) -> DataFrame:
    """(pk, kind) of every row that differs; where no prefix up to the cap decodes, an exact comparison of fingerprints by key."""
    with R.Session(source, spec) as a, R.Session(target, spec) as b:
        got, _ = reconcile_rateless(a.rows.select("fp", "id"), b.rows.select("fp", "id"), **options)
        if not got.complete:
            return R.full_outer(source, target, spec)
        found = [tuple(r) for r in R.resolve(a, b, got).collect()]  # as many as the decoded difference
    return R.recheck(source, target, spec, source.sparkSession.createDataFrame(found, "pk string, on_source boolean, on_target boolean"))
