"""Packs as a data source: spark.read.format("strata_pack").load(path) lists the
pages of the current version with their raw bytes; .option("table", ...) takes
another of its tables as stored."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..errors import Corruption
from ..functions import codecs
from .fs import parse_slot, slot_paths
from .pack import TABLES

RAW_PAGES = "entry long, block int, page int, raw binary"


class _File(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.table = to_arrow_schema(schema), options["path"], options.get("table", "pages")
        self.raw = "table" not in {k.lower() for k in options}

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        slots = []
        for path in slot_paths(f"{root}/CURRENT"):
            if fs.get_file_info(path).type == pafs.FileType.File:
                with fs.open_input_file(path) as f:
                    slots.append(parse_slot(f.readall()))
        there = lambda v: fs.get_file_info(f"{root}/versions/{v['version']}/manifest.json").type == pafs.FileType.File
        usable = [v for v in slots if v and there(v)]
        if not usable:
            raise Corruption(f"no usable pointer in {self.path}")
        version = max(usable, key=lambda v: v["epoch"])["version"]
        files = fs.get_file_info(pafs.FileSelector(f"{root}/versions/{version}/{self.table}"))
        return [_File(f.path) for f in files if f.path.endswith(".parquet")]

    def read(self, partition: _File):
        fs, _ = pafs.FileSystem.from_uri(self.path if "://" in self.path or self.path.startswith("file:") else f"file://{self.path}")
        for batch in ds.dataset(partition.uri, filesystem=fs, format="parquet").to_batches(batch_size=512):
            if self.raw:
                rows = [r for r in batch.to_pylist() if r["kind"] == "page"]
                made = [{"entry": r["entry"], "block": r["block"], "page": r["page"], "raw": codecs.decode(r["codec"], r["payload"], r["raw_size"], r["raw_crc"])} for r in rows]
                yield pa.RecordBatch.from_pylist(made, schema=self.schema)
            else:
                yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in self.schema], schema=self.schema)


class PackSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "strata_pack"

    def schema(self) -> str:
        table = self.options.get("table")
        return TABLES[table] if table else RAW_PAGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PackSource)
