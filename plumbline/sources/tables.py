"""Parquet table scans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SAMPLE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Parquet scan; a declared schema saves the footer read on very many files."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


class Tables:
    """Lazy, named scans of ``<root>/<name>.parquet``: ``t.orders``, ``t["orders"]``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._schemas: dict[str, T.StructType] = {}

    def __getitem__(self, name: str) -> DataFrame:
        # file footers are read for the schema once per table, not once per use
        df = scan(self.spark, f"{self.root}/{name}.parquet", self._schemas.get(name))
        self._schemas.setdefault(name, df.schema)
        return df

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self[name]

    def pick(self, names: Iterable[str] = SAMPLE_TABLES) -> dict[str, DataFrame]:
        return {name: self[name] for name in names}
