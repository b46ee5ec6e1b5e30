"""Two-round reconciliation of two copies of a table, and the classification of what differs."""

from __future__ import annotations

import math
import secrets
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..spec import TableSpec
from .decode import Decoded, peel
from .sketch import fingerprints, sketch, to_arrays

ALPHA, MARGIN = 1.52, 1.2


def second_size(d_hat: float, alpha: float = ALPHA, margin: float = MARGIN) -> int | None:
    """Cells of the second round, from the first round's estimate; None where there is no usable estimate."""
    return math.ceil(alpha * margin * d_hat) if math.isfinite(d_hat) and d_hat > 0 else None


@dataclass
class Outcome:
    status: str  # 'OK' or 'FALLBACK'
    rounds: int
    d_hat: float
    decoded: Decoded
    candidates: DataFrame | None  # (pk, on_source, on_target), None on FALLBACK


class Session:
    """Fingerprints of one table copy, scanned once and kept for the second round and for resolving ids."""

    def __init__(self, table: DataFrame, spec: TableSpec):
        self.rows = fingerprints(table, spec).persist()

    def sketch(self, cells: int, seed: int) -> DataFrame:
        return sketch(self.rows, cells, seed)

    def __enter__(self) -> Session:
        return self

    def __exit__(self, *exc) -> None:
        self.rows.unpersist()


def compare(source: Session, target: Session, cells: int = 512, cap: int = 1 << 22, seed: int | None = None, joint: bool = True, alpha: float = ALPHA, margin: float = MARGIN) -> Outcome:
    """Decode what differs in at most two rounds; FALLBACK when the second would exceed `cap` cells or fails."""

    def view(m: int, s: int):
        both = source.rows.withColumn("sign", F.lit(1)).unionByName(target.rows.withColumn("sign", F.lit(-1)))
        return to_arrays(sketch(both, m, s, "sign"), m)

    seed = secrets.randbits(63) if seed is None else seed
    first = view(cells, seed)
    got, rounds = peel([first], [seed]), 1
    if not got.complete:
        size = second_size(got.d_hat, alpha, margin)
        if size is None or size > cap or size <= 3:
            return Outcome("FALLBACK", 1, got.d_hat, got, None)
        again = seed + 1
        second = view(size, again)
        d_hat = got.d_hat
        got, rounds = (peel([first, second], [seed, again]) if joint else peel([second], [again])), 2
        got.d_hat = d_hat
        if not got.complete:
            return Outcome("FALLBACK", 2, d_hat, got, None)
    return Outcome("OK", rounds, got.d_hat, got, resolve(source, target, got))


def resolve(source: Session, target: Session, decoded: Decoded) -> DataFrame:
    """Keys of the decoded ids, each side read where the id was found; the ids are as many as the difference was decoded to."""
    spark = source.rows.sparkSession

    def keys(side: Session, symbols: list[tuple[int, int]]) -> DataFrame:
        ids = spark.createDataFrame([(r,) for r in sorted({r for _, r in symbols})], "id long")
        return side.rows.join(ids, "id").groupBy("id").agg(F.min("pk").alias("pk")).select("pk")

    a, b = keys(source, decoded.plus).withColumn("on_source", F.lit(True)), keys(target, decoded.minus).withColumn("on_target", F.lit(True))
    return a.join(b, "pk", "full_outer").select("pk", F.coalesce("on_source", F.lit(False)).alias("on_source"), F.coalesce("on_target", F.lit(False)).alias("on_target"))


def recheck(source: DataFrame, target: DataFrame, spec: TableSpec, candidates: DataFrame) -> DataFrame:
    """Re-read the candidate rows of both sides and classify them by presence and full 128-bit digest."""
    side = lambda t, name: t.select(C.pk_wire(spec).alias("pk"), F.md5(C.row_text(spec)).alias(name)).join(candidates.select("pk"), "pk", "left_semi")
    both = side(source, "a").join(side(target, "b"), "pk", "full_outer")
    kind = F.when(F.col("b").isNull(), "source_only").when(F.col("a").isNull(), "target_only").when(F.col("a") != F.col("b"), "changed")
    return both.select("pk", kind.alias("kind")).where("kind IS NOT NULL")


def reconcile(source: DataFrame, target: DataFrame, spec: TableSpec, **options) -> DataFrame:
    """(pk, kind) of every row that differs; where the sketch falls back, an exact comparison of fingerprints by key."""
    with Session(source, spec) as a, Session(target, spec) as b:
        out = compare(a, b, **options)
        if out.candidates is None:
            return full_outer(source, target, spec)
        found = out.candidates.collect()  # as many as the decoded difference
    rows = source.sparkSession.createDataFrame([tuple(r) for r in found], "pk string, on_source boolean, on_target boolean")
    return recheck(source, target, spec, rows)


def full_outer(source: DataFrame, target: DataFrame, spec: TableSpec) -> DataFrame:
    """The same answer by a full outer join of the fingerprints on the key."""
    side = lambda t, name: t.select(C.pk_wire(spec).alias("pk"), F.md5(C.row_text(spec)).alias(name))
    both = side(source, "a").join(side(target, "b"), "pk", "full_outer")
    kind = F.when(F.col("b").isNull(), "source_only").when(F.col("a").isNull(), "target_only").when(F.col("a") != F.col("b"), "changed")
    return both.select("pk", kind.alias("kind")).where("kind IS NOT NULL")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(columns..., side, copies): rows with more copies on one side, by one signed count per distinct row."""
    cols = a.columns
    counted = a.withColumn("n", F.lit(1)).unionByName(b.select(*cols).withColumn("n", F.lit(-1))).groupBy(*cols).agg(F.sum("n").alias("n")).where("n <> 0")
    return counted.select(*cols, F.when(F.col("n") > 0, "plus").otherwise("minus").alias("side"), F.abs("n").alias("copies"))
