"""Invertible sketches of fingerprint streams: build, merge, subtract, estimate.

A sketch is a DataFrame (cell, cnt, fp_xor, id_xor, chk_xor) of at most M rows, linear in its rows: the partial and final
aggregation of one grouped job are the merge. Each partition folds its rows into one numpy sketch before anything is
shuffled, so the exchange carries at most partitions * M rows and a key that a third of all rows share costs nothing extra.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import hashing as H
from ..spec import TableSpec

CELLS = "cell int, cnt long, fp_xor long, id_xor long, chk_xor long"


def fingerprints(table: DataFrame, spec: TableSpec) -> DataFrame:
    """(fp, id, pk): one row per table row; pk is the wire form of the key."""

    def ids(batches):
        for batch in batches:
            raw = batch.column(1).to_pylist()
            got = H.cheap_ids(raw) if raw else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64()), batch.column(2)], names=["fp", "id", "pk"])

    return table.select(F.coalesce(C.fingerprint(spec), F.lit(0)).alias("fp"), C.pk_bytes(spec).alias("raw"), C.pk_wire(spec).alias("pk")).mapInArrow(ids, "fp long, id long, pk string")


def key_id(spec: TableSpec):
    """The id of a single integer key as a pure expression (its encoding is two 8-byte chunks)."""
    head = H.literal(H.CHECKSUM_SEED ^ 0x0101000000000008)
    first = H.sm64_column(head).bitwiseXOR(F.col(spec.keys[0]).cast("long"))
    return H.sm64_column(H.sm64_column(first)).bitwiseAND(F.lit(H.FP_MASK))


def _fold(fp: np.ndarray, ids: np.ndarray, sign: np.ndarray, cells: int, seed: int, into: np.ndarray) -> None:
    """Add rows to a 4 x M sketch; xor within equal cells by sorting, so that it is a reduceat and no Python loop."""
    at = H.positions(fp, cells, seed).ravel()
    order = np.argsort(at, kind="stable")
    at, row = at[order], order // H.K
    edge = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    if not len(at):
        return
    cell = at[edge]
    into[0, cell] += np.add.reduceat(sign[row], edge).view(np.uint64)
    for k, v in ((1, fp.view(np.uint64)), (2, ids.view(np.uint64)), (3, H.checksum(fp.view(np.uint64)))):
        into[k, cell] ^= np.bitwise_xor.reduceat(v[row], edge)


def sketch(rows: DataFrame, cells: int, seed: int = 0, sign: str | None = None) -> DataFrame:
    """Cells of rows(fp, id); `sign` names a +1/-1 column, so that two sides of a union are subtracted as they are built."""
    if cells <= H.K:
        raise ValueError(f"a sketch needs more than {H.K} cells")

    def build(batches):
        held = np.zeros((4, cells), np.uint64)
        for batch in batches:
            fp, ids, s = (batch.column(i).to_numpy() for i in range(3))
            for lo in range(0, len(fp), 200_000):
                _fold(fp[lo : lo + 200_000].view(np.uint64), ids[lo : lo + 200_000], s[lo : lo + 200_000], cells, seed, held)
        used = np.flatnonzero(held.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(held[k, used].view(np.int64)) for k in range(4))], names=[c.split()[0] for c in CELLS.split(", ")])

    partial = rows.select("fp", "id", (F.col(sign) if sign else F.lit(1)).cast("long").alias("s")).mapInArrow(build, CELLS)
    return merge(partial)


def merge(cells: DataFrame) -> DataFrame:
    """One row per cell of any union of sketches of the same size and seed; empty cells are left out."""
    out = cells.groupBy("cell").agg(F.sum("cnt").alias("cnt"), *(F.bit_xor(c).alias(c) for c in ("fp_xor", "id_xor", "chk_xor")))
    return out.where("cnt <> 0 OR fp_xor <> 0 OR id_xor <> 0 OR chk_xor <> 0")


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return merge(a.unionByName(b.withColumn("cnt", -F.col("cnt"))))


def estimate(difference: DataFrame, cells: int) -> DataFrame:
    """d_hat: size of the difference, from the second moment of the signed counts; absent cells count as 0."""
    second, first = F.coalesce(F.sum(F.col("cnt") * F.col("cnt")), F.lit(0)).cast("double"), F.coalesce(F.sum("cnt"), F.lit(0)).cast("double")
    return difference.agg(((second - first * first / cells) / (H.K * (1 - H.K / cells))).alias("d_hat"))


def to_arrays(cells_frame: DataFrame, cells: int) -> np.ndarray:
    """The 4 x M array of a sketch on the driver; its size is M, whatever the table's."""
    out = np.zeros((4, cells), np.uint64)
    got = cells_frame.select("cell", "cnt", "fp_xor", "id_xor", "chk_xor").toArrow()
    at = got.column(0).to_numpy()
    for k in range(4):
        out[k, at] = got.column(k + 1).to_numpy().view(np.uint64)
    return out


def estimate_array(view: np.ndarray) -> float:
    counts = view[0].view(np.int64).astype(float)
    m = len(counts)
    return float((counts @ counts - counts.sum() ** 2 / m) / (H.K * (1 - H.K / m)))
