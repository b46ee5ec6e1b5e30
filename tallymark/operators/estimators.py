"""Other estimators of the size of a difference: strata, tug-of-war and the streaming estimate over coded symbols."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H


def strata_cells(rows: DataFrame, strata: int = 32, cells: int = 80, sign: str = "sign") -> DataFrame:
    """(stratum, cell, cnt, fp_xor, chk_xor): a small difference sketch for every number of trailing zeros of the mixed fingerprint."""

    def spread(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            mixed = H.sm64(fp ^ np.uint64(H.RETRY_STEP))
            low = mixed & (~mixed + np.uint64(1))
            zeros = np.where(mixed == 0, 63, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64))
            at = H.positions(fp, cells, 0x5715)
            k = H.K
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.minimum(zeros, strata - 1), k).astype(np.int32)), pa.array(at.ravel().astype(np.int32)), pa.array(np.repeat(batch.column(1).to_numpy(), k)), pa.array(np.repeat(fp, k).view(np.int64)), pa.array(np.repeat(H.checksum(fp), k).view(np.int64))], names=["stratum", "cell", "s", "fp", "chk"])

    wide = rows.select("fp", F.col(sign).cast("long").alias("s")).mapInArrow(spread, "stratum int, cell int, s long, fp long, chk long")
    return wide.groupBy("stratum", "cell").agg(F.sum("s").alias("cnt"), F.bit_xor("fp").alias("fp_xor"), F.bit_xor("chk").alias("chk_xor"))


def strata_estimate(cells: DataFrame, strata: int = 32, size: int = 80) -> float:
    """Decode from the sparsest stratum down; the first that fails scales what was found above it. At most strata * size rows are gathered."""
    from .decode import peel

    views = np.zeros((strata, 4, size), np.uint64)
    for r in cells.collect():
        views[r["stratum"]][[0, 1, 3], r["cell"]] = np.array([r["cnt"], r["fp_xor"], r["chk_xor"]], np.int64).view(np.uint64)
    found = 0
    for i in range(strata - 1, -1, -1):
        got = peel([views[i]], [0x5715])
        if not got.complete:
            return float(found << (i + 1))
        found += len(got.plus) + len(got.minus)
    return float(found)


def tug_of_war(rows: DataFrame, counters: int = 128, sign: str = "sign") -> DataFrame:
    """d_hat: mean square of `counters` signed sums, each row adding +1 or -1 by a bit of its hash; folded per partition first."""

    def fold(batches):
        total = np.zeros(counters, np.int64)
        for batch in batches:
            fp, s = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for j in range(counters):
                bit = (H.sm64(fp + np.uint64((j + 1) * H.RETRY_STEP & H.MASK)) >> np.uint64(63)).astype(np.int64)
                total[j] += int((s * (1 - 2 * bit)).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(counters, dtype=np.int32)), pa.array(total)], names=["counter", "total"])

    parts = rows.select("fp", F.col(sign).cast("long").alias("s")).mapInArrow(fold, "counter int, total long")
    return parts.groupBy("counter").agg(F.sum("total").alias("total")).agg(F.avg(F.col("total") * F.col("total")).alias("d_hat"))


def streaming_estimate(symbols: DataFrame) -> DataFrame:
    """d_hat from coded symbols (idx, cnt) 0..r: mean over i >= 1 of (C_i - q_i C_0)^2 / (q_i (1 - q_i)), q_i = 8 (i + 1) / (2 i + 3)^2."""
    first = symbols.where("idx = 0").select(F.col("cnt").alias("c0"))
    i = F.col("idx")
    q = 8.0 * (i + 1) / ((2.0 * i + 3) * (2.0 * i + 3))
    term = (F.col("cnt") - q * F.col("c0")) * (F.col("cnt") - q * F.col("c0")) / (q * (1 - q))
    return symbols.where("idx >= 1").join(F.broadcast(first)).agg(F.avg(term).alias("d_hat"))
