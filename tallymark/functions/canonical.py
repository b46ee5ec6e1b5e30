"""Canonical row text and fingerprints as column expressions: they stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import PkType, TableSpec, ValueType

UNIT = "\x1f"
NULL_TOKEN = "<NULL>"


def pk_text(column: str, kind: PkType, lower: bool = True) -> Column:
    c = F.col(column)
    if kind is PkType.INT64:
        return c.cast("long").cast("string")
    if kind is PkType.DECIMAL:
        t = c.cast("decimal(38,10)").cast("string")
        t = F.when(t.contains("."), F.regexp_replace(F.regexp_replace(t, "0+$", ""), "[.]$", "")).otherwise(t)
        return F.when(t == "-0", F.lit("0")).otherwise(t)
    t = F.rtrim(c.cast("string"))
    return F.lower(t) if lower else t


def value_text(column: str, kind: ValueType) -> Column:
    c = F.col(column)
    if kind is ValueType.INT:
        return c.cast("long").cast("string")
    if kind is ValueType.MONEY2:
        return F.round(c.cast("decimal(24,6)") * 100, 0).cast("decimal(38,0)").cast("string")
    if kind is ValueType.DECIMAL4:
        return F.round(c.cast("decimal(24,8)") * 10000, 0).cast("decimal(38,0)").cast("string")
    if kind is ValueType.DATETIME_SEC:
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return c.cast("string")


def _with_nulls(text: Column, mode: str) -> Column:
    return text if mode == "propagate" else F.coalesce(text, F.lit(NULL_TOKEN if mode == "token" else ""))


def row_text(spec: TableSpec) -> Column:
    """Key and value texts joined by the unit separator; lower-cased as a whole when the spec says so."""
    parts = [_with_nulls(pk_text(c, k, spec.lower), spec.nulls) for c, k in spec.pk] + [_with_nulls(value_text(c, k), spec.nulls) for c, k in spec.values]
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit(UNIT), p)
    return F.lower(joined) if spec.lower else joined


def md5_fingerprint(md5_hex: Column) -> Column:
    """First 56 bits of an MD5, as a non-negative long."""
    return F.conv(F.substring(md5_hex, 1, 14), 16, 10).cast("long")


def fingerprint(spec: TableSpec) -> Column:
    return md5_fingerprint(F.md5(row_text(spec)))


def pk_wire(spec: TableSpec) -> Column:
    """One key as its text; several as CK1: and dot-joined unpadded url-safe base64 of each."""
    texts = [pk_text(c, k, spec.lower) for c, k in spec.pk]
    if len(texts) == 1:
        return texts[0]
    safe = [F.translate(F.rtrim(F.translate(F.base64(F.coalesce(t, F.lit("")).cast("binary")), "=\r\n", " ")), "+/", "-_") for t in texts]
    return F.concat(F.lit("CK1:"), F.concat_ws(".", *safe))


def pk_unwire(wire: Column, arity: int) -> list[Column]:
    """The key texts of a wire value."""
    if arity == 1:
        return [wire]
    body = F.split(F.substring(wire, 5, 1 << 30), "[.]")
    return [F.unbase64(F.translate(body[i], "-_", "+/")).cast("string") for i in range(arity)]


def pk_bytes(spec: TableSpec) -> Column:
    """Injective tag-length-value encoding of the key tuple: version, arity, then per column tag, null flag, length, bytes."""

    def number(width: int, c: Column) -> Column:
        return F.unhex(F.lpad(F.hex(c), 2 * width, "0"))

    parts = [F.unhex(F.lit(f"01{len(spec.pk):02x}"))]
    for c, k in spec.pk:
        tag = f"{k.value:02x}"
        raw = number(8, F.col(c).cast("long")) if k is PkType.INT64 else pk_text(c, k, spec.lower).cast("binary")
        present = F.concat(F.unhex(F.lit(tag + "00")), number(4, F.octet_length(raw).cast("long")), raw)
        parts.append(F.when(F.col(c).isNull(), F.unhex(F.lit(tag + "01"))).otherwise(present))
    return F.concat(*parts)
