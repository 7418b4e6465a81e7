"""Facts about tables that come from their schemas, and tolerant column access."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMN_FACTS = T.StructType([
    T.StructField("table_name", T.StringType(), False),
    T.StructField("ordinal", T.IntegerType(), False),
    T.StructField("column_name", T.StringType(), False),
    T.StructField("data_type", T.StringType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("char_max_len", T.IntegerType(), True),
    T.StructField("numeric_precision", T.IntegerType(), True),
    T.StructField("numeric_scale", T.IntegerType(), True),
    T.StructField("is_nullable", T.BooleanType(), False),
])


def kind_of(data_type: T.DataType) -> str:
    """number, string, date, bool or other."""
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, T.NumericType):
        return "number"
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "other"


def column_facts(tables: Mapping[str, DataFrame], spark: SparkSession | None = None) -> DataFrame:
    """One row per declared column. Sized by the number of columns, never by rows."""
    rows = []
    for table, df in tables.items():
        for i, field in enumerate(df.schema.fields, start=1):
            dt = field.dataType
            # a scan shows char and varchar columns as string and keeps the declaration here
            declared = field.metadata.get("__CHAR_VARCHAR_TYPE_STRING", dt.simpleString())
            length = re.match(r"(?:var)?char\((\d+)\)", declared)
            rows.append((
                table, i, field.name, declared, kind_of(dt), int(length.group(1)) if length else None,
                dt.precision if isinstance(dt, T.DecimalType) else None,
                dt.scale if isinstance(dt, T.DecimalType) else None,
                field.nullable,
            ))
    session = spark or next(iter(tables.values())).sparkSession
    return session.createDataFrame(rows, COLUMN_FACTS)


def pick(df: DataFrame, *names: str, default: object = None) -> Column:
    """First non-null of the candidate spellings that ``df`` really has."""
    have = [F.col(f"`{n}`") for n in names if n in df.columns]
    return F.coalesce(*have, F.lit(default)) if have else F.lit(default)


def truthy(value: Column) -> Column:
    """Boolean, 1 or the words true/enabled/yes, in any case; null counts as false."""
    return F.coalesce(F.lower(value.cast("string")).isin("true", "1", "enabled", "yes", "on"), F.lit(False))


def falsy(value: Column) -> Column:
    return F.coalesce(F.lower(value.cast("string")).isin("false", "0", "disabled", "no", "off"), F.lit(False))
