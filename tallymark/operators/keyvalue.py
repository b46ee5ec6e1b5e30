"""Comparison of key-value data: canonical digests per value type and hash-bucket checksum vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions.canonical import md5_fingerprint


def _u32(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(c.cast("long")), 8, "0"))


def _sized(c: Column) -> Column:
    raw = c.cast("binary")
    return F.concat(_u32(F.octet_length(raw)), raw)


def _item(c: Column) -> Column:
    return F.concat(F.unhex(F.lit("01")), _sized(c))


def _joined(parts: Column) -> Column:
    return F.unhex(F.array_join(F.transform(parts, lambda p: F.hex(p)), ""))


def canonical_value(kind: str, value: Column) -> Column:
    """Bytes of a value that do not depend on the order in which sets and hashes were written.

    string: string; list, zset, stream: array<string> in order; set: array<string>; hash: map<string,string>.
    """
    head = _sized(F.lit(kind))
    if kind == "string":
        return F.concat(head, _item(value))
    if kind in ("list", "zset", "stream"):
        return F.concat(head, F.unhex(F.lit("03")), _u32(F.size(value)), _joined(F.transform(value, _item)))
    if kind == "set":
        return F.concat(head, _u32(F.size(value)), _joined(F.transform(F.array_sort(F.transform(value, lambda v: v.cast("binary"))), _sized)))
    if kind == "hash":
        pairs = F.array_sort(F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("binary").alias("k"), e["value"].cast("binary").alias("v"))))
        return F.concat(head, _u32(F.size(pairs)), _joined(F.transform(pairs, lambda e: F.concat(_sized(e["k"]), _sized(e["v"])))))
    raise ValueError(f"unknown value kind: {kind}")


KINDS = {"string": "str", "list": "list", "set": "set", "hash": "hash", "zset": "zset", "stream": "stream"}


def digests(store: DataFrame, include_key: bool = True) -> DataFrame:
    """(key, digest, fp) of store(key, type, str, list, set, hash, zset, stream); absent value columns are allowed.

    With include_key the key is part of the fingerprint, so equal values under different keys stay decodable.
    """
    value = F.lit(None).cast("binary")
    for kind, column in KINDS.items():
        if column in store.columns:
            value = F.when(F.col("type") == kind, canonical_value(kind, F.col(column))).otherwise(value)
    plain = F.concat(F.col("type").cast("binary"), F.unhex(F.lit("00")), value)
    digest = F.md5(plain)
    fp = F.md5(F.concat(F.col("key").cast("binary"), F.unhex(F.lit("00")), plain)) if include_key else digest
    return store.select("key", digest.alias("digest"), md5_fingerprint(fp).alias("fp"))


def with_ids(rows: DataFrame) -> DataFrame:
    """rows(key, ...) with the 56-bit id of the key as a one-column string key."""

    def ids(batches):
        for batch in batches:
            raw = [b"\x01\x01\x02\x00" + len(k).to_bytes(4, "big") + k for k in (s.encode() for s in batch.column(0).to_pylist())]
            got = H.cheap_ids(raw) if raw else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.int64())], names=[*batch.schema.names, "id"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select("key", *[c for c in rows.columns if c != "key"]).schema.fields)
    return rows.select("key", *[c for c in rows.columns if c != "key"]).mapInArrow(ids, f"{kinds}, id long")


def bucket_of(ids: Column, buckets: int) -> Column:
    return H.unsigned_mod(H.sm64_column(ids), buckets).cast("int")


def bucket_vector(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n, fp_xor, fp_sum, id_xor) of rows(id, fp); the sum wraps at 2^64 and is shown as a signed long."""
    total = F.pmod(F.sum(F.col("fp").cast("decimal(20,0)")).cast("decimal(38,0)"), F.lit("18446744073709551616").cast("decimal(20,0)"))
    wrapped = F.when(total >= F.lit("9223372036854775808").cast("decimal(20,0)"), total - F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(total).cast("long")
    return rows.groupBy(bucket_of(F.col("id"), buckets).alias("bucket")).agg(F.count("*").alias("n"), F.bit_xor("fp").alias("fp_xor"), wrapped.alias("fp_sum"), F.bit_xor("id").alias("id_xor"))


def dirty_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets whose vectors differ, a missing one included."""
    cols = ["n", "fp_xor", "fp_sum", "id_xor"]
    both = a.select("bucket", F.struct(*cols).alias("x")).join(b.select("bucket", F.struct(*cols).alias("y")), "bucket", "full_outer")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).select("bucket")


def compare(source: DataFrame, target: DataFrame, buckets: int = 4096) -> DataFrame:
    """(key, kind) of rows(key, id, fp) that differ: only rows of dirty buckets are joined."""
    bad = dirty_buckets(bucket_vector(source, buckets), bucket_vector(target, buckets))
    rows = [t.withColumn("bucket", bucket_of(F.col("id"), buckets)).join(bad, "bucket", "left_semi").select("key", F.col("fp").alias(n)) for t, n in ((source, "x"), (target, "y"))]
    kind = F.when(F.col("y").isNull(), "source_only").when(F.col("x").isNull(), "target_only").when(F.col("x") != F.col("y"), "changed")
    return rows[0].join(rows[1], "key", "full_outer").select("key", kind.alias("kind")).where("kind IS NOT NULL")
