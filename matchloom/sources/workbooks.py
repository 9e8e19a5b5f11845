"""Workbooks as a Spark data source: `spark.dataSource.register(Workbooks)`, then `spark.read.format("workbook").load(folder)`.

One partition a file, and a row of cells at a time from the open file, so a large workbook is held neither as bytes nor as a
tree.  The path must be mounted on all executors; files in a store that only Spark reads go through `offers.read_xlsx_cells`.
"""

from __future__ import annotations

import glob
import hashlib
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import ExtractionError


class Workbooks(DataSource):
    """path, source_hash, row, column, value, is_number of the first sheets."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> str:
        return "path string, source_hash string, row int, column int, value string, is_number boolean"

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[File]:
        found = sorted(glob.glob(f"{self.path}/*.xls[xm]")) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        if not found:
            raise ExtractionError("no workbooks", path=self.path)
        return [File(p) for p in found]

    def read(self, partition: File) -> Iterator[tuple]:
        from .offers import sheet_cells

        digest = hashlib.sha256()
        with open(partition.path, "rb") as f:
            while part := f.read(1 << 20):
                digest.update(part)
        for cell in sheet_cells(partition.path):
            yield (partition.path, digest.hexdigest(), *cell)
