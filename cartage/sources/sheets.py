"""``spark.read.format("sheet")``: folders of small spreadsheets as one table, a partition a file.

Every row is (file, row_number, cells: header to text, error): files of different headers fit one schema, and a file that cannot be
read is one row with its error, not a failed job.  The files must lie where all executors see them under one path.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass
from zipfile import BadZipFile

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cartage.sources.files import read_sheet


@dataclass
class SheetFile(InputPartition):
    path: str


class SheetReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[SheetFile]:
        inside = os.path.join(self.path, "*") if os.path.isdir(self.path) else self.path
        return [SheetFile(p) for p in sorted(glob.glob(inside)) if os.path.isfile(p)] or [SheetFile("")]

    def read(self, partition: SheetFile) -> Iterator[tuple]:
        if not partition.path:
            return
        try:
            with open(partition.path, "rb") as f:
                _, rows = read_sheet(os.path.basename(partition.path), f.read())
        except (ValueError, KeyError, IndexError, SyntaxError, BadZipFile) as x:
            yield partition.path, None, None, str(x) or type(x).__name__
            return
        for number, row in enumerate(rows, start=1):
            yield partition.path, number, row, None


class SheetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> str:
        return "file string, row_number long, cells map<string, string>, error string"

    def reader(self, schema: object) -> SheetReader:
        if not self.options.get("path"):
            raise ValueError("a sheet source needs a path")
        return SheetReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("sheet")`` known to the session."""
    spark.dataSource.register(SheetSource)
