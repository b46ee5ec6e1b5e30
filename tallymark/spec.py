"""What a table to reconcile looks like: key columns and value columns with engine-independent types."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class PkType(Enum):
    INT64 = 0
    DECIMAL = 1
    STRING = 2


class ValueType(Enum):
    STRING = "string"
    INT = "int"
    MONEY2 = "money2"
    DECIMAL4 = "decimal4"
    DATETIME_SEC = "datetime"


_VALUE_NAMES = {
    "string": ValueType.STRING, "varchar": ValueType.STRING, "char": ValueType.STRING,
    "int": ValueType.INT, "int64": ValueType.INT, "bigint": ValueType.INT, "serial": ValueType.INT,
    "money2": ValueType.MONEY2,
    "decimal4": ValueType.DECIMAL4, "numeric4": ValueType.DECIMAL4,
    "datetime": ValueType.DATETIME_SEC, "date": ValueType.DATETIME_SEC, "timestamp": ValueType.DATETIME_SEC,
}


def value_type(name: str) -> ValueType:
    """The value type of a type name as users write it."""
    try:
        return _VALUE_NAMES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown value type: {name}") from None


def pk_type(name: str) -> PkType:
    """The key type of a database's type name."""
    n = name.strip().lower()
    if ("int" in n and "interval" not in n) or "serial" in n:
        return PkType.INT64
    return PkType.DECIMAL if "decimal" in n or "numeric" in n else PkType.STRING


@dataclass(frozen=True)
class TableSpec:
    pk: tuple[tuple[str, PkType], ...]
    values: tuple[tuple[str, ValueType], ...]
    lower: bool = True
    nulls: str = "token"  # 'token': '<NULL>'; 'empty': ''; 'propagate': the row's text is null

    @property
    def keys(self) -> list[str]:
        return [c for c, _ in self.pk]


ORDERS = TableSpec((("o_orderkey", PkType.INT64),), (("o_custkey", ValueType.INT), ("o_orderstatus", ValueType.STRING), ("o_totalprice", ValueType.MONEY2), ("o_orderpriority", ValueType.STRING)))
CUSTOMER = TableSpec((("c_custkey", PkType.INT64),), (("c_name", ValueType.STRING), ("c_nationkey", ValueType.INT), ("c_acctbal", ValueType.MONEY2), ("c_mktsegment", ValueType.STRING)))
PART = TableSpec((("p_partkey", PkType.INT64),), (("p_name", ValueType.STRING), ("p_brand", ValueType.STRING), ("p_retailprice", ValueType.MONEY2)))
