"""SQL type names, numeric promotion, and the type checks made before a query runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import CatalogError, TypeMismatch

#: Type names of the SQL dialect by the kind of value they hold (fixed values).
INT64 = ("INT", "INTEGER", "BIGINT", "INT8", "INT4", "INT64")
UINT16 = ("SMALLINT", "INT2", "INT16", "UINT16")
UINT32 = ("UINT32", "INT32")
UTF8 = ("TEXT", "VARCHAR", "CHAR", "JSON", "STRING", "UUID", "TIMESTAMP", "DATETIME", "DATE")

KINDS = {name: kind for kind, names in (("int64", INT64), ("uint16", UINT16), ("uint32", UINT32), ("utf8", UTF8)) for name in names}
SPARK = {"int64": T.LongType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "utf8": T.StringType()}
RANGES = {"uint16": (0, 2**16 - 1), "uint32": (0, 2**32 - 1)}


def kind_of(name: str) -> str:
    kind = KINDS.get(name.upper())
    if kind is None:
        raise CatalogError(f"Unknown type '{name}'", "Known types: " + ", ".join(KINDS))
    return kind


def family(t: T.DataType) -> str:
    if isinstance(t, T.NullType):
        return "unknown"
    if isinstance(t, T.NumericType):
        return "numeric"
    return t.typeName()


def promote(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The common type of two comparable operands (None: no coercion is needed); raises if there is none."""
    if a == b or "unknown" in (family(a), family(b)):
        return None
    if family(a) == family(b) == "numeric":
        for kind in (T.DoubleType, T.FloatType):
            if isinstance(a, kind) or isinstance(b, kind):
                return T.DoubleType()
        for t in (a, b):
            if isinstance(t, T.DecimalType):
                return t
        return T.LongType()
    raise TypeMismatch(f"Type mismatch: cannot compare {a.simpleString()} to {b.simpleString()}", "Cast one side.")


def compare(df: DataFrame, left: Column, op: str, right: Column) -> Column:
    """A comparison whose operand types are checked when it is built, not when it runs."""
    types = [f.dataType for f in df.select(left.alias("l"), right.alias("r")).schema]
    promote(*types)
    return {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def in_range(kind: str, value: Column) -> Column:
    """Whether a value fits the declared kind; NULL fits."""
    if kind not in RANGES:
        return F.lit(True)
    return F.coalesce(value.between(*RANGES[kind]), F.lit(True))
