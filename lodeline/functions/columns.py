"""Column names and kinds."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The hidden column that keeps the order of a source.
ORDER = "_ord"


def q(name: str) -> str:
    """A name quoted for use in an expression."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def user_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ORDER]


def unique_names(labels: Iterable[object]) -> list[str]:
    """White space collapsed, blanks named by place, repeats numbered until unique."""
    out: list[str] = []
    for place, label in enumerate(labels, 1):
        base = " ".join(str("" if label is None else label).split()) or f"column_{place}"
        name, k = base, 1
        while name in out:
            k += 1
            name = f"{base}_{k}"
        out.append(name)
    return out


def spark_names(names: list[str]) -> list[str]:
    """Physical names that stay distinct where case is ignored."""
    seen: set[str] = set()
    out = []
    for name in names:
        physical, k = name, 1
        while physical.lower() in seen or physical.lower() == ORDER:
            k += 1
            physical = f"{name}_{k}"
        seen.add(physical.lower())
        out.append(physical)
    return out


def kind(field: T.StructField) -> str:
    """datetime, numeric, bool, text or other."""
    if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(field.dataType, T.NumericType):
        return "numeric"
    if isinstance(field.dataType, T.BooleanType):
        return "bool"
    return "text" if isinstance(field.dataType, (T.StringType, T.CharType, T.VarcharType)) else "other"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind(f) for f in df.schema.fields if f.name != ORDER}


def number(name: str, of: str = "numeric") -> Column:
    """A numeric column as double, NaN as NULL."""
    c = col(name).cast("double")
    return F.when(~F.isnan(c), c)


def shown(name: str, of: str) -> Column:
    """A value as text, booleans as True and False."""
    text = col(name).cast("string")
    return F.initcap(text) if of == "bool" else text


def present(name: str, df: DataFrame) -> Column:
    """Not missing: not NULL, and not NaN where the type has it."""
    f = df.schema[name]
    c = col(name)
    return c.isNotNull() & ~F.isnan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.isNotNull()


def with_order(df: DataFrame) -> DataFrame:
    return df if ORDER in df.columns else df.withColumn(ORDER, F.monotonically_increasing_id())
