"""read(): one call that opens a .npy, .npz or .parquet file as lazy DataFrames with their metadata."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import parquet as ops
from tessera.sources import numpy_files
from tessera.sources.footer import ColumnInfo, read_footer


@dataclass
class TableResult:
    source: dict[str, str]
    row_count: int
    schema: list[ColumnInfo]
    df: DataFrame
    metadata: dict[str, object] = field(default_factory=dict)
    kind: str = "table"
    version: int = 1

    @property
    def column_count(self) -> int:
        return len(self.schema)


@dataclass
class ArrayResult(TableResult):
    shape: tuple[int, ...] = ()
    kind: str = "array"


@dataclass
class BundleResult:
    source: dict[str, str]
    names: list[str]
    arrays: dict[str, ArrayResult]
    df: DataFrame  # long form: name, pos, values
    metadata: dict[str, object]
    kind: str = "bundle"


@dataclass
class InspectionResult:
    metadata: dict[str, object]
    table: TableResult
    summary: DataFrame
    kind: str = "inspection"


def _array(df: DataFrame, path: str, h: numpy_files.Header) -> ArrayResult:
    info = {"fortranOrder": h.fortran, "originalShape": h.shape, "ndim": len(h.shape), "elementSize": h.dtype.itemsize}
    return ArrayResult({"format": "npy", "path": path}, h.count, [ColumnInfo("values", h.descr, None, "PLAIN", "UNCOMPRESSED")], df, info, shape=h.shape)


def read_npy(spark: SparkSession, path: str, workers: int = 0, chunk_bytes: int = numpy_files.CHUNK_BYTES, small_file_bytes: int = numpy_files.SMALL_FILE_BYTES, order: str = "storage", with_pos: bool = True) -> ArrayResult:
    numpy_files.register(spark)
    h = numpy_files.header_of(numpy_files.names_in_task(path, ".npy")[0])
    options = {"numPartitions": workers, "chunkBytes": chunk_bytes, "smallFileBytes": small_file_bytes, "order": order, "withPos": str(with_pos).lower()}
    return _array(spark.read.format("npy").options(**options).load(path), path, h)


def read_npz(spark: SparkSession, path: str) -> BundleResult:
    numpy_files.register(spark)
    found = numpy_files.members(path)
    one = lambda m: spark.read.format("npz").option("member", m.name).load(path).select("pos", "values")
    arrays = {m.name: _array(one(m), m.entry, m.header) for m in found}
    return BundleResult({"format": "npz", "path": path}, [m.name for m in found], arrays, spark.read.format("npz").load(path), {"entryCount": len(found)})


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None, sample: bool = False, inspect: bool = False, contract: bool = False, on_missing: str = "ignore", null_policy: str = "sentinel", sample_by: str | None = None) -> TableResult | InspectionResult:
    """sample: the first rows of each row group, or with sample_by those of the whole table in order of that column."""
    footer = read_footer(spark, path)
    df = ops.scan(spark, path, footer)
    if sample:
        df = ops.first_by(df, sample_by) if sample_by else ops.sample(df, footer)
    df = ops.project(df, columns, on_missing)
    names = set(df.columns)
    schema = [c for c in footer.columns if c.name in names]
    described = {c.name: {"parquetType": c.parquet_type, "encoding": c.encoding, "compression": c.compression, "dtype": c.dtype} for c in schema}
    df = df.select(*[F.col(ops.quoted(c)).alias(c, metadata=described.get(c, {})) for c in df.columns])
    if contract:
        df = ops.contract_view(df, null_policy, ops.millis_columns(footer))
    parts = [footer.row_count] if sample_by else [n for _, groups in footer.files for n in groups]
    returned = sum(min(ops.SAMPLE_ROWS, n) for n in parts) if sample else footer.row_count
    table = TableResult({"format": "parquet", "path": path}, footer.row_count, schema, df, {"rowGroups": footer.row_groups, "returnedRows": returned})
    if not inspect:
        return table
    return InspectionResult({"rowCount": footer.row_count, "rowGroups": footer.row_groups, "schema": schema}, table, ops.summary(spark, path, footer, columns))


_OPTIONS = {"columns": "columns", "sample": "sample", "inspect": "inspect", "contract": "contract", "on_missing": "on_missing", "null_policy": "null_policy", "sample_by": "sample_by"}


def read(spark: SparkSession, path: str, format: str | None = None, **config: object) -> TableResult | ArrayResult | BundleResult | InspectionResult:
    """Dispatch on the text after the last point of the path, in lower case, or on `format`. Options that a format does
    not have are ignored; for .npy: workers, chunkSizeMB, smallFileMB, order, with_pos."""
    kind = (format or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if kind == "npy":
        own = {k: config[k] for k in ("workers", "order", "with_pos") if k in config}
        mb = {"chunk_bytes": "chunkSizeMB", "small_file_bytes": "smallFileMB"}
        own |= {k: int(float(config[v]) * (1 << 20)) for k, v in mb.items() if v in config}
        return read_npy(spark, path, **own)
    if kind == "npz":
        return read_npz(spark, path)
    if kind == "parquet":
        return read_parquet(spark, path, **{v: config[k] for k, v in _OPTIONS.items() if config.get(k) is not None})
    raise ValueError(f"Unsupported format: {kind}")
