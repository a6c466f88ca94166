"""Versioned Parquet tables, published by replacing one small pointer file."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.storage import Folder

POINTER = "CURRENT"


class Table:
    """One table below a root folder. Readers resolve the pointer once; a failed write leaves the old version in place.

    One writer at a time, many readers.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str):
        self.spark, self.schema = spark, schema
        self.folder = Folder(spark, f"{root}/{name}")

    def _version(self) -> str | None:
        return self.folder.read_text(POINTER).strip() if self.folder.exists(POINTER) else None

    def read(self) -> DataFrame:
        version = self._version()
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.folder.at(version))

    def replace(self, df: DataFrame) -> None:
        """Writes a new version, publishes it, then drops the old one."""
        old, new = self._version(), f"v{uuid.uuid4().hex}"
        self._fitted(df).write.parquet(self.folder.at(new))
        self.folder.write_text(POINTER, new)
        if old:
            self.folder.delete(old)

    def append(self, df: DataFrame) -> None:
        version = self._version()
        if version is None:
            self.replace(df)
        else:
            self._fitted(df).write.mode("append").parquet(self.folder.at(version))

    def append_rows(self, rows: list[tuple]) -> None:
        self.append(self.spark.createDataFrame(rows, self.schema).coalesce(1))

    def next_id(self, column: str) -> int:
        return (self.read().agg(F.max(column).alias("m")).first()["m"] or 0) + 1

    def drop(self) -> None:
        self.folder.delete("")

    def _fitted(self, df: DataFrame) -> DataFrame:
        fields = [f.strip().rsplit(" ", 1) for f in self.schema.split(",")]
        return df.select(*[F.col(n).cast(t).alias(n) for n, t in fields])
