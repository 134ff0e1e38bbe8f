"""A dataset class: Parquet files, a partition for each row group, as a batch or a stream with offsets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType


class Group(InputPartition):
    def __init__(self, path: str, group: int):
        super().__init__((path, group))
        self.path, self.group = path, group


def _files(path: str) -> list[str]:
    import pyarrow.dataset as ds

    return sorted(ds.dataset(path, format="parquet").files)


def _groups(path: str) -> list[Group]:
    return [Group(f, g) for f in _files(path) for g in range(pq.ParquetFile(f).num_row_groups)]


def _rows(part: Group) -> Iterator[pa.RecordBatch]:
    yield from pq.ParquetFile(part.path).read_row_group(part.group).to_batches()


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Group]:
        return _groups(self.path)

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        return _rows(partition)


class _Stream(DataSourceStreamReader):
    """Offsets count row groups, ``groups`` of them a micro-batch."""

    def __init__(self, path: str, groups: int):
        self.path, self.groups, self.last = path, groups, None

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        n = len(_groups(self.path))
        self.last = n if self.last is None and not self.groups else min(n, (self.last or 0) + (self.groups or n))
        return {"at": self.last}

    def partitions(self, start: dict, end: dict) -> list[Group]:
        self.last = max(self.last or 0, end["at"])
        return _groups(self.path)[start["at"] : end["at"]]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        return _rows(partition)


class RowGroups(DataSource):
    """Options: path; groups (of a micro-batch; all without it)."""

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def schema(self) -> StructType:
        return from_arrow_schema(pq.read_schema(_files(self.options["path"])[0]))

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options["path"], int(self.options.get("groups", "0")))
