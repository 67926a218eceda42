"""Arrays that keep arriving: a folder of .npy files as a stream of (file, values) rows."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.numpy_files import parse_header


def _doubles(content: pd.Series) -> pd.Series:
    def one(raw: bytes) -> np.ndarray:
        f = io.BytesIO(raw)
        h = parse_header(f)
        return np.frombuffer(raw, h.dtype, h.count, h.offset).astype(np.float64)

    return content.map(one)


def stream_npy(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """(path, pos, values as double), each file as a micro-batch row set; files should be small, as arrivals are. Large
    arrays belong to the batch source, which reads them in ranges."""
    raw = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.npy").option("maxFilesPerTrigger", max_files).load(folder)
    )
    doubles = F.pandas_udf(_doubles, "array<double>")
    return raw.select("path", F.posexplode(doubles("content")).alias("pos", "values"))
