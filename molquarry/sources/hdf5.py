"""HDF5 tables as a Spark data source (SRC3): row ranges are read by the executors, batch by batch.

`spark.dataSource.register(Hdf5Source)` once, then `spark.read.format("molquarry_hdf5")` with the options
`path` and `table`, and as wanted `columns` (comma separated), `start`, `end` (rows [start, end)), `batch` (rows a
batch) and `part` (rows a partition). The file must lie where all executors can read it. Needs h5py.

A structured dataset has a column for each of its fields; a flat one has a column `value`, numbers or, in two
dimensions, arrays. Byte strings are decoded as UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

BATCH_ROWS = 8_192
PART_ROWS = 500_000


def open_file(path: str):
    try:
        import h5py
    except ImportError as missing:
        raise ImportError("reading HDF5 needs the h5py library") from missing
    return h5py.File(path, "r")


def arrow_type(dtype: np.dtype) -> pa.DataType:
    if dtype.subdtype:
        return pa.list_(arrow_type(dtype.subdtype[0]))
    return pa.string() if dtype.kind in "SUO" else pa.from_numpy_dtype(dtype)


def fields_of(dataset) -> list[tuple[str, pa.DataType]]:
    """(name, type) of the columns of a dataset."""
    if dataset.dtype.names:
        return [(n, arrow_type(dataset.dtype[n])) for n in dataset.dtype.names]
    kind = arrow_type(dataset.dtype)
    return [("value", kind if len(dataset.shape) == 1 else pa.list_(kind))]


def as_arrow(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    if pa.types.is_string(kind):
        return pa.array([v.decode() if isinstance(v, bytes) else None if v is None else str(v) for v in values.tolist()], pa.string())
    return pa.array(values.tolist() if values.ndim > 1 else values, kind)


class Rows(InputPartition):
    def __init__(self, start: int, end: int):
        super().__init__((start, end))
        self.start, self.end = start, end


class Hdf5Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], columns: list[str]):
        self.options, self.columns = options, columns

    def partitions(self) -> list[InputPartition]:
        with open_file(self.options["path"]) as file:
            rows = file[self.options["table"]].shape[0]
        low = int(self.options.get("start", 0))
        high = min(rows, int(self.options.get("end", rows)))
        part = int(self.options.get("part", PART_ROWS))
        return [Rows(i, min(i + part, high)) for i in range(low, high, part)] or [Rows(0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        step = int(self.options.get("batch", BATCH_ROWS))
        with open_file(self.options["path"]) as file:
            dataset = file[self.options["table"]]
            kinds = dict(fields_of(dataset))
            for i in range(partition.start, partition.end, step):
                rows = dataset[i : min(i + step, partition.end)]
                yield pa.RecordBatch.from_arrays([as_arrow(rows[c] if rows.dtype.names else rows, kinds[c]) for c in self.columns], self.columns)


class Hdf5Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "molquarry_hdf5"

    def _kept(self) -> list[tuple[str, pa.DataType]]:
        with open_file(self.options["path"]) as file:
            held = fields_of(file[self.options["table"]])
        wanted = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else [n for n, _ in held]
        return [(c, dict(held)[c]) for c in wanted]

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(pa.schema(self._kept()))

    def reader(self, schema: StructType) -> DataSourceReader:
        return Hdf5Reader(dict(self.options), schema.names)


def table_shapes(path: str) -> dict[str, tuple[int, ...]]:
    """The shape of every dataset of a file, from its metadata alone."""
    with open_file(path) as file:
        return {name: tuple(file[name].shape) for name in file.keys()}
