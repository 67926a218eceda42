"""Parquet footers, read on the driver without a Spark job."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession

from tessera.functions.types import contract_dtype
from tessera.sources.files import data_files, read_range


@dataclass(frozen=True)
class ColumnInfo:
    name: str
    dtype: str
    parquet_type: str | None
    encoding: str
    compression: str
    encodings: tuple[str, ...] = ()


@dataclass(frozen=True)
class Footer:
    files: tuple[tuple[str, tuple[int, ...]], ...]  # file, rows of each row group
    columns: tuple[ColumnInfo, ...]
    schema: pa.Schema

    @property
    def row_count(self) -> int:
        return sum(sum(groups) for _, groups in self.files)

    @property
    def row_groups(self) -> int:
        return sum(len(groups) for _, groups in self.files)


def metadata_of(spark: SparkSession, file: str, size: int) -> pq.FileMetaData:
    if size < 12 or (tail := read_range(spark, file, size - 8, 8))[4:] != b"PAR1":
        raise ValueError(f"Invalid Parquet file: {file}")
    length = int.from_bytes(tail[:4], "little")
    if length > size - 12:
        raise ValueError(f"Invalid Parquet file: {file}: footer of {length} bytes")
    # A footer can be parsed without the pages before it.
    return pq.ParquetFile(pa.BufferReader(b"PAR1" + read_range(spark, file, size - 8 - length, length) + tail)).metadata


def _codec(name: str) -> str:
    return {"LZ4": "LZ4_RAW"}.get(name, name)


def read_footer(spark: SparkSession, path: str) -> Footer:
    """Of a file, or of all data files of a folder; columns as in the first file."""
    files, first = [], None
    for file, size in data_files(spark, path):
        meta = metadata_of(spark, file, size)
        first = first or meta
        files.append((file, tuple(meta.row_group(k).num_rows for k in range(meta.num_row_groups))))
    if first is None:
        raise ValueError(f"no Parquet file in {path}")
    columns = []
    for field in first.schema.to_arrow_schema():
        leaf = next((k for k in range(first.num_columns) if first.schema.column(k).path == field.name), None)
        if leaf is None:  # a group: no values of its own
            columns.append(ColumnInfo(field.name, "unknown", None, "PLAIN", "UNCOMPRESSED"))
            continue
        kind = first.schema.column(leaf).physical_type
        chunk = first.row_group(0).column(leaf) if first.num_row_groups else None
        encodings = tuple(chunk.encodings) if chunk else ()
        columns.append(ColumnInfo(field.name, contract_dtype(kind), kind, encodings[0] if encodings else "PLAIN", _codec(chunk.compression) if chunk else "UNCOMPRESSED", encodings))
    return Footer(tuple(files), tuple(columns), first.schema.to_arrow_schema())
