"""Named tables, loaders and their metadata (SRC, BatchPartition)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molquarry.functions.values import null_sentinels
from molquarry.operators.positions import dense_positions
from molquarry.operators.select import rows_between


@dataclass
class CsvLoader:
    """A delimited file with a header: column subset and half-open row range [start, end). A range
    needs positions, which follow the file's line order (path, then place in it)."""

    path: str
    columns: list[str] | None = None
    rows: tuple[int, int] | None = None
    sep: str = ","
    schema: str | None = None
    missing_to_null: bool = True

    def load(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.option("header", True).option("sep", self.sep).option("escape", '"')
        df = (reader.schema(self.schema) if self.schema else reader.option("inferSchema", True)).csv(self.path)
        df = df.withColumn("_file", F.input_file_name()).withColumn("_line", F.monotonically_increasing_id())
        df = dense_positions(df, ["_file", "_line"]).drop("_file", "_line") if self.rows else df.drop("_file", "_line")
        if self.rows:
            df = rows_between(df, *self.rows)
        wanted = [*(["row_id"] if self.rows else []), *(self.columns or [c for c in df.columns if c != "row_id"])]
        df = df.select(*wanted)
        if self.missing_to_null:
            for c, kind in df.dtypes:
                if kind == "string":
                    df = df.withColumn(c, null_sentinels(c))
        return df


@dataclass
class ParquetLoader:
    """The native store: column subset and positional selection reach the scan."""

    path: str
    columns: list[str] | None = None
    selection: list[int] | None = None
    row_id: str = "row_id"

    def load(self, spark: SparkSession) -> DataFrame:
        df = spark.read.parquet(self.path)
        if self.selection is not None:
            df = df.where(F.col(self.row_id).isin(self.selection))
        return df.select(*self.columns) if self.columns else df


@dataclass
class ExcelLoader:
    """A sheet of a workbook, where an Excel reader for pandas is installed."""

    path: str
    sheet: str
    columns: list[str] | None = None
    rows: tuple[int, int] | None = None

    def load(self, spark: SparkSession) -> DataFrame:
        try:
            frame = pd.read_excel(self.path, sheet_name=self.sheet, usecols=self.columns)
        except ImportError as missing:
            raise ImportError("reading workbooks needs an Excel reader for pandas") from missing
        return spark.createDataFrame(frame.iloc[slice(*self.rows)] if self.rows else frame)


@dataclass
class Hdf5Loader:
    """A dataset of an HDF5 file through the data source of hdf5.py, where h5py is installed. rows is a range
    [start, end); positions are joined by row number."""

    path: str
    table: str
    columns: list[str] | None = None
    rows: tuple[int, int] | None = None

    def load(self, spark: SparkSession) -> DataFrame:
        from molquarry.sources.hdf5 import Hdf5Source, open_file

        with open_file(self.path):  # a missing library or file is told here, not by a worker
            pass
        spark.dataSource.register(Hdf5Source)
        reader = spark.read.format(Hdf5Source.name()).option("path", self.path).option("table", self.table)
        if self.columns:
            reader = reader.option("columns", ",".join(self.columns))
        if self.rows:
            reader = reader.option("start", self.rows[0]).option("end", self.rows[1])
        return reader.load()


def from_numpy(spark: SparkSession, array: np.ndarray) -> DataFrame:
    """A structured array by its fields; a flat one as a column named None."""
    if array.dtype.names:
        return spark.createDataFrame(pd.DataFrame({n: list(array[n]) for n in array.dtype.names}))
    return spark.createDataFrame(pd.DataFrame({"None": list(array)}))


def from_pandas(spark: SparkSession, frame: pd.DataFrame) -> DataFrame:
    """A pandas frame; object columns become text, missing entries null."""
    texts = [c for c in frame.columns if frame[c].dtype == object]
    return spark.createDataFrame(frame.assign(**{c: frame[c].map(lambda v: None if v is None or v != v else str(v)) for c in texts}))


@dataclass
class Catalog:
    """A dictionary of named tables, each also a temporary view; existing names raise."""

    spark: SparkSession
    prefix: str = ""
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def add(self, name: str, df: DataFrame) -> DataFrame:
        if name in self.tables:
            raise ValueError(f"the table {name} exists")
        self.tables[name] = df
        df.createOrReplaceTempView(self.prefix + name)
        return df

    def load(self, loaders: list | dict) -> Catalog:
        named = loaders if isinstance(loaders, dict) else {str(i): x for i, x in enumerate(loaders)}
        for name, loader in named.items():
            self.add(name, loader.load(self.spark))
        return self

    def create(self, name: str, schema: str, data: list | pd.DataFrame | None = None) -> DataFrame:
        """An empty table, or one of the given rows."""
        return self.add(name, self.spark.createDataFrame([] if data is None else data, schema))

    def replace(self, name: str, df: DataFrame) -> DataFrame:
        self.drop(name)
        return self.add(name, df)

    def copy(self, old: str, new: str) -> DataFrame:
        """The same rows under another name; frames don't change, so nothing is written."""
        return self.add(new, self.tables[old])

    def resize(self, name: str, rows: int, order: list[str]) -> DataFrame:
        """The first rows in the given order, or more with null rows at the end."""
        df = self.tables[name]
        placed = dense_positions(df, order, "_place")
        more = rows - df.count()
        out = placed.where(F.col("_place") < rows).drop("_place")
        if more > 0:
            out = out.unionByName(self.spark.range(more).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields)))
        return self.replace(name, out)

    def rename(self, old: str, new: str) -> None:
        df = self.tables[old]
        self.add(new, df)
        self.drop(old)

    def drop(self, name: str) -> None:
        del self.tables[name]
        self.spark.catalog.dropTempView(self.prefix + name)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def names(self) -> list[str]:
        return list(self.tables)

    def shape(self, name: str) -> tuple[int, int]:
        return self.tables[name].count(), len(self.tables[name].columns)


def rows_by_file(df: DataFrame) -> DataFrame:
    """(file, rows): the row count of each source file, by its name."""
    return df.groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.count(F.lit(1)).alias("rows"))
