"""Managed tables: folders of Parquet files that the tenant's log names, committed optimistically.

A write makes a folder of its own and then commits; readers pin a version and never see a half-written one.  An append
writes only its rows and keeps the older folders, until there are many, which it then writes together.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from granary.sources.log import ConflictError, TenantLog

__all__ = ["ConflictError", "ManagedTable"]


class ManagedTable:
    #: An append to a table of so many folders writes all of its rows anew.
    MOST_FOLDERS = 64

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, log: TenantLog, name: str | None = None):
        self.spark, self.path, self.schema, self.log = spark, path.rstrip("/"), schema, log
        self.name = name or self.path.rpartition("/")[2]  # in the log

    def version(self) -> int:
        """The last committed version; -1 before the first."""
        return self.log.table(self.name)[0]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one by default."""
        at, folders = self.log.table(self.name)
        return self.rows(folders if version in (None, at) else [] if version < 0 else self.log.folders_at(self.name, version))

    def rows(self, folders: Sequence[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        # Added columns are missing in older files and read as null.
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}" for f in folders))

    def write(self, rows: DataFrame, base: int) -> str:
        """Writes rows to a folder that nobody reads before it is committed; returns its name."""
        folder = f"v{base + 1}-{uuid.uuid4().hex[:12]}"
        rows.write.parquet(f"{self.path}/data/{folder}")
        return folder

    def commit(self, rows: DataFrame, base: int) -> int:
        """Makes ``rows`` the version after ``base``."""
        self.log.commit({self.name: (base, [self.write(rows, base)])})
        return base + 1

    def appended(self, rows: DataFrame, base: int, folders: Sequence[str]) -> list[str]:
        """The folders of the version after ``base`` that has these rows besides its own."""
        if len(folders) >= self.MOST_FOLDERS:
            return [self.write(self.rows(folders).unionByName(rows), base)]
        return [*folders, self.write(rows, base)]

    def drop(self) -> None:
        fs, where = self.log._fs(self.path)
        fs.delete(where, True)
