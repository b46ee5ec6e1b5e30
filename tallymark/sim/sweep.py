"""Second rounds of reconciliation tried again and again, with new seeds, over fingerprints that were scanned once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators.decode import peel
from ..sources.scratch import Scratch

CELLS = "trial int, round int, cell int, cnt long, fp_xor long, id_xor long, chk_xor long"


def differing(source: DataFrame, target: DataFrame) -> DataFrame:
    """(fp, id, net) of the fingerprints that do not cancel; sketches are linear, so every sketch of the difference can be made of these."""
    both = source.select("fp", "id", F.lit(1).alias("s")).unionByName(target.select("fp", "id", F.lit(-1).alias("s")))
    return both.groupBy("fp", "id").agg(F.sum("s").alias("net")).where("net <> 0")


def trial_seeds(base: int, trial: int) -> tuple[int, int]:
    first, second = (H._sm((base + 2 * trial + i) & H.MASK) or 1 for i in (0, 1))
    return first, second if second != first else H._sm((second + 1) & H.MASK) or 1


def sketches(rows: DataFrame, plans: list[tuple[int, int, int, int]]) -> DataFrame:
    """Cells of the difference sketches of rows(fp, id, net) for every (trial, round, cells, seed) planned, summed before they are shuffled."""

    def spread(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                part = batch.slice(lo, 20_000)
                fp, ids, net = (part.column(i).to_numpy() for i in range(3))
                odd = np.where(net & 1, -1, 0)  # an even number of copies cancels in an xor
                repeated = [np.repeat(v, H.K) for v in (net, fp & odd, ids & odd, H.checksum(fp.view(np.uint64)).view(np.int64) & odd)]
                for trial, turn, cells, seed in plans:
                    at = H.positions(fp.view(np.uint64), cells, seed).ravel().astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), v, np.int32)) for v in (trial, turn)] + [pa.array(at), *map(pa.array, repeated)], names=[c.split()[0] for c in CELLS.split(", ")])

    wide = rows.select("fp", "id", F.col("net").cast("long").alias("net")).mapInArrow(spread, CELLS)
    return wide.groupBy("trial", "round", "cell").agg(F.sum("cnt").alias("cnt"), *(F.bit_xor(c).alias(c) for c in ("fp_xor", "id_xor", "chk_xor")))


def _decode(cells: DataFrame, plans: list[tuple[int, int, int, int]]) -> DataFrame:
    """(trial, d_hat, decoded): every trial's views peeled together; a task holds the cells of one trial."""
    known: dict[int, list[tuple[int, int, int]]] = {}
    for trial, turn, size, seed in plans:
        known.setdefault(trial, []).append((turn, size, seed))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        trial = int(rows["trial"].iloc[0])
        views, seeds = [], []
        for turn, size, seed in known[trial]:
            view, here = np.zeros((4, size), np.uint64), rows[rows["round"] == turn]
            for k, c in enumerate(("cnt", "fp_xor", "id_xor", "chk_xor")):
                view[k, here["cell"]] = here[c].to_numpy(np.int64).view(np.uint64)
            views.append(view)
            seeds.append(seed)
        got = peel(views, seeds)
        return pd.DataFrame({"trial": [trial], "d_hat": [got.d_hat], "decoded": [got.complete]})

    return cells.groupBy("trial").applyInPandas(one, "trial int, d_hat double, decoded boolean")


def second_rounds(source: DataFrame, target: DataFrame, trials: int, cells: int = 512, alpha: float = 1.52, seed: int = 20260720) -> DataFrame:
    """(trial, d_hat, decoded_first, second_cells, decoded_second) over two tables of (fp, id).

    Every trial has new seeds; after a failed first round, ceil(alpha * d_hat) cells are added and both rounds are peeled jointly.
    second_cells and decoded_second are null where the first round was enough. Equal tables give trials that all decode. The driver
    holds one small row per trial. Both rounds of a trial stand on one task, as they do on the driver of a comparison.
    """
    spark = source.sparkSession
    rows = Scratch(spark, "sweep").save(differing(source, target))
    seeds = [trial_seeds(seed, t) for t in range(trials)]
    plans = [(t, 0, cells, s) for t, (s, _) in enumerate(seeds)]
    first = {r["trial"]: r for r in _decode(sketches(rows, plans), plans).collect()}  # one row per trial
    lost = {t: max(H.K + 1, math.ceil(alpha * r["d_hat"])) for t, r in first.items() if not r["decoded"]}
    after = [(t, turn, size, s) for t, m in sorted(lost.items()) for turn, size, s in ((0, cells, seeds[t][0]), (1, m, seeds[t][1]))]
    table = [(t, first[t]["d_hat"] if t in first else 0.0, t not in lost, lost.get(t)) for t in range(trials)]
    known = spark.createDataFrame(table, "trial int, d_hat double, decoded_first boolean, second_cells int")
    second = _decode(sketches(rows, after), after).select("trial", F.col("decoded").alias("decoded_second"))
    return known.join(second, "trial", "left")


def sweep_summary(rounds: DataFrame) -> DataFrame:
    """One row: first-round failures, how many of them the second round mended, its failure rate, and three over n where it never failed."""
    lost = ~F.col("decoded_first")
    got = rounds.agg(
        F.count("*").alias("trials"), F.count_if(lost).alias("failed_first"), F.count_if("decoded_second").alias("decoded_second"), F.count_if(~F.col("decoded_second")).alias("failed_second"),
        F.avg(F.when(lost, F.col("d_hat"))).alias("mean_d_hat"), F.min("second_cells").alias("min_second_cells"), F.max("second_cells").alias("max_second_cells"),
    )
    n = F.nullif("failed_first", F.lit(0))
    return got.withColumn("failure_rate", F.col("failed_second") / n).withColumn("upper_95", F.when(F.col("failed_second") == 0, 3.0 / n))
