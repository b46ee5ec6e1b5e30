"""A sketch in built-in expressions alone, with its own positions and checksum (not interchangeable with the mapped sketch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the quadratic checksum.
LINEAR, CONSTANT, MODULUS = 1000003, 1442695040888963407, 9223372036854775807


def pushdown_cells(rows: DataFrame, cells: int) -> DataFrame:
    """(cell, cnt, fp_xor, id_xor, chk_xor) of rows(id, fp): cells are three bit ranges of the fingerprint modulo `cells`, each counted once.

    The exploded rows carry the checksum, so the hash below is evaluated once; explode_outer keeps the optimizer from adding a
    size filter that would evaluate it again.
    """
    fp = F.col("fp")
    at = F.array_distinct(F.array(*(F.pmod(F.shiftrightunsigned(fp, s), F.lit(cells).cast("long")) for s in (0, 20, 40))))
    wide = fp.cast("decimal(19,0)")
    check = F.pmod((wide * wide + wide * F.lit(LINEAR).cast("decimal(7,0)")).cast("decimal(38,0)") + F.lit(CONSTANT).cast("decimal(19,0)"), F.lit(MODULUS).cast("decimal(19,0)")).cast("long")
    spread = rows.select("id", "fp", check.alias("chk"), F.explode_outer(at).alias("cell"))
    return spread.groupBy(F.col("cell").cast("int").alias("cell")).agg(F.count("*").alias("cnt"), F.bit_xor("fp").alias("fp_xor"), F.bit_xor("id").alias("id_xor"), F.bit_xor("chk").alias("chk_xor"))
