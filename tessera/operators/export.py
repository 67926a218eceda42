"""Sinks. CSV, JSON and Parquet are Spark's; .npy files are written by tasks, Arrow goes through Spark's converter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def to_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("lineSep", "\n").csv(path)


def to_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def to_parquet(df: DataFrame, path: str, **options: object) -> None:
    df.write.mode("overwrite").options(**options).parquet(path)


def to_npy(df: DataFrame, path: str, values: str = "values", pos: str | None = "pos") -> int:
    """A folder of part files, one per task, which the npy source reads as one array. With pos, rows are dealt out by
    range of pos, so files in order of name hold the values in order of pos. Returns the number of values. Files of
    lost attempts are removed from the listing by a commit step that renames the winners' files."""
    ordered = df.repartitionByRange(pos).sortWithinPartitions(pos) if pos else df

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from numpy.lib import format as npy_format
        from pyarrow import fs
        from pyspark import TaskContext

        parts = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if parts and sum(map(len, parts)):
            whole = np.concatenate(parts)
            system, base = fs.FileSystem.from_uri(path)
            system.create_dir(base, recursive=True)
            name = f"part-{TaskContext.get().partitionId():06d}.npy"
            temp = f"{base}/_{name}-{uuid.uuid4().hex}"
            with system.open_output_stream(temp) as f:
                npy_format.write_array_header_1_0(f, {"descr": whole.dtype.str, "fortran_order": False, "shape": whole.shape})
                f.write(whole.tobytes())
            yield pa.RecordBatch.from_pydict({"temp": [temp], "file": [f"{base}/{name}"], "n": [len(whole)]})

    done = ordered.select(values).mapInArrow(write, "temp string, file string, n long").collect()  # one row per file
    from pyarrow import fs

    system, _ = fs.FileSystem.from_uri(path)
    for r in done:
        system.move(r.temp, r.file)
    return sum(r.n for r in done)


def to_arrow(df: DataFrame) -> pa.Table:
    return df.toArrow()


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow IPC file or stream as a DataFrame; read on the driver, so for files that fit there."""
    from tessera.sources.files import open_in_task

    with open_in_task(path) as f:
        try:
            table = pa.ipc.open_file(f).read_all()
        except pa.ArrowInvalid:
            f.seek(0)
            table = pa.ipc.open_stream(f).read_all()
    return spark.createDataFrame(table)
