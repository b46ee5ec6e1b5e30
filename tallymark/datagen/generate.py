"""Deterministic wide tables with injected differences, as expressions over a range: any size, no driver loop, no shuffle."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 100_000
# Fixed values of the jump-key permutation.
STEP, SALT, PRIME = 2654435761, 2246822519, (1 << 31) - 1


def jump_key(i: Column, spacing: int = 16, seed: int = 1) -> Column:
    """Sparse, distinct keys in rising order: one slot per row within `spacing`, by a multiplicative hash."""
    return i * spacing + F.pmod(F.pmod(i * F.lit(STEP) + F.lit(seed * SALT), F.lit(PRIME)), F.lit(spacing))


def other_key(i: Column, spacing: int = 16, seed: int = 1) -> Column:
    """A key next to row i's that no row has: for rows that exist on one side only."""
    return i * spacing + F.pmod(jump_key(i, spacing, seed) + 1, F.lit(spacing))


def base36(v: Column, width: int) -> Column:
    """Fixed-width base-36 text whose order is that of the numbers."""
    return F.lpad(F.lower(F.conv(v.cast("string"), 10, 36)), width, "0")


def from_base36(text: Column) -> Column:
    return F.conv(text, 36, 10).cast("long")


@dataclass(frozen=True)
class Profile:
    """rows, and how many of them are modified, on the source only and on the target only; spread over `dirty_blocks` blocks."""

    rows: int
    modified: int
    source_only: int
    target_only: int
    values: int = 4
    dirty_blocks: int = 1
    block: int = BLOCK

    def per_block(self, n: int) -> int:
        return math.ceil(n / self.dirty_blocks) if n else 0

    @property
    def counts(self) -> tuple[int, int, int]:
        """What is really injected: totals are rounded up per dirty block."""
        return tuple(self.per_block(n) * self.dirty_blocks for n in (self.modified, self.source_only, self.target_only))  # type: ignore[return-value]

    @property
    def d_row(self) -> int:
        return sum(self.counts)

    @property
    def d_ms(self) -> int:
        return self.d_row + self.counts[0]


def _values(p: Profile, i: Column, changed: Column) -> list[Column]:
    """bigint, text, money and time columns in turn, null in a fixed pattern; the first follows `changed`."""
    out = []
    for k in range(p.values):
        h = F.xxhash64(i, F.lit(k))
        kind = [F.pmod(h, F.lit(1_000_000)), F.concat(F.lit("v"), F.hex(h)), (F.pmod(h, F.lit(10**9)) / 10000).cast("decimal(24,4)"), F.timestamp_seconds(F.lit(1_600_000_000) + F.pmod(h, F.lit(10**8))).cast("timestamp_ntz")][k % 4]
        c = F.when(F.pmod(i + k, F.lit(11)) != 0, kind) if k else F.when(changed, kind + 1_000_003).otherwise(kind)
        out.append(c.alias(f"value_{k:02d}"))
    return out


def table(spark: SparkSession, p: Profile, side: str) -> DataFrame:
    """The 'source' or 'target' copy: (key_01, value_00...)."""
    if p.dirty_blocks * p.block > p.rows + p.block - 1 and p.dirty_blocks > 1:
        raise ValueError("more dirty blocks than the table has")
    i, stride = F.col("id"), max(p.rows // p.block // p.dirty_blocks, 1)
    block, at = F.floor(i / p.block), F.pmod(i, F.lit(p.block))
    is_dirty = (F.pmod(block, F.lit(stride)) == 0) & (block / stride < p.dirty_blocks)
    m, s, t = (p.per_block(n) for n in (p.modified, p.source_only, p.target_only))
    changed = is_dirty & (at < m)
    lone = is_dirty & (at >= m) & (at < m + s)
    extra = is_dirty & (at >= m + s) & (at < m + s + t)
    rows = spark.range(p.rows)
    if side == "source":
        return rows.select(jump_key(i).alias("key_01"), *_values(p, i, F.lit(False)))
    kept = rows.where(~lone).select(jump_key(i).alias("key_01"), *_values(p, i, changed))
    return kept.unionByName(rows.where(extra).select(other_key(i).alias("key_01"), *_values(p, i, F.lit(False))))


def key_values(spark: SparkSession, rows: int, modified: int, source_only: int, target_only: int, side: str) -> DataFrame:
    """String pairs under k:%012d keys, and one key of each other kind written in opposite orders on the two sides."""
    i = F.col("id")
    key = F.concat(F.lit("k:"), F.lpad(i.cast("string"), 12, "0"))
    text = F.when(i < modified, F.concat(F.lit(f"modified-{side}:"), i.cast("string"))).otherwise(F.concat(F.lit("same:"), i.cast("string")))
    first = rows if side == "source" else rows + source_only
    own = spark.range(first, first + (source_only if side == "source" else target_only))
    base = spark.range(rows).unionByName(own).select(key.alias("key"), F.lit("string").alias("type"), text.alias("str"))
    parts = ["x", "y", "z"] if side == "source" else ["z", "y", "x"]
    arr = F.array(*map(F.lit, parts))
    pairs = F.create_map(*(F.lit(v) for p in parts for v in (p, p + p)))
    fixed = F.array(*map(F.lit, "xyz"))
    null = lambda kind: F.lit(None).cast(kind)
    kinds = {"set": (arr, "set"), "hash": (pairs, "hash"), "list": (fixed, "list"), "zset": (fixed, "zset"), "stream": (fixed, "stream")}
    types = {"list": "array<string>", "set": "array<string>", "hash": "map<string,string>", "zset": "array<string>", "stream": "array<string>"}
    out = base.select("key", "type", "str", *(null(t).alias(c) for c, t in types.items()))
    for kind, (value, column) in kinds.items():
        one = spark.range(1).select(F.lit(f"mixed:{kind}").alias("key"), F.lit(kind).alias("type"), null("string").alias("str"), *((value if c == column else null(t)).alias(c) for c, t in types.items()))
        out = out.unionByName(one)
    return out
