"""Type tables: dtypes of the result contract, Spark types of NumPy dtypes, null sentinels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

# Parquet physical type -> contract dtype.
PARQUET_DTYPES = {"INT32": "i4", "INT64": "f8", "FLOAT": "f4", "DOUBLE": "f8", "BOOLEAN": "u1", "BYTE_ARRAY": "string"}
# What stands for null in the contract view.
SENTINELS = {"i4": -2147483648, "u1": 255, "f4": float("nan"), "f8": float("nan"), "string": "null"}


def normalized(descr: str | None) -> str:
    """A dtype without byte-order marks; 'unknown' if nothing is left."""
    return (descr or "").strip().lstrip("<>=|") or "unknown"


def contract_dtype(parquet_type: str | None) -> str:
    return PARQUET_DTYPES.get(parquet_type or "", "unknown")


def itemsize(descr: str) -> int:
    return np.dtype(descr).itemsize


def spark_type(dtype: np.dtype) -> T.DataType:
    """The Spark type of array elements. Unsigned types widen; Spark has none."""
    plain = {
        "f2": T.FloatType(), "f4": T.FloatType(), "f8": T.DoubleType(), "i1": T.ByteType(), "i2": T.ShortType(), "i4": T.IntegerType(),
        "i8": T.LongType(), "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "u8": T.DecimalType(20, 0), "b1": T.BooleanType(),
    }
    if dtype.names:
        raise ValueError(f"structured dtype {dtype.descr} has no single column")
    if dtype.kind in "US":
        return T.StringType() if dtype.kind == "U" else T.BinaryType()
    if dtype.kind == "c":
        return T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])
    if dtype.kind in "Mm":
        return T.LongType()
    if (key := f"{dtype.kind}{dtype.itemsize}") in plain:
        return plain[key]
    raise ValueError(f"unsupported dtype {dtype.str}")


def arrow_values(values: np.ndarray) -> pa.Array:
    """A one-dimensional NumPy array as the Arrow form of spark_type()."""
    if not values.dtype.isnative:
        values = values.astype(values.dtype.newbyteorder("="))
    kind, size = values.dtype.kind, values.dtype.itemsize
    if kind == "u":
        if size == 8:
            return pa.array([int(x) for x in values], pa.decimal128(20, 0))
        return pa.array(values.astype({1: np.int16, 2: np.int32, 4: np.int64}[size]))
    if kind == "f" and size == 2:
        return pa.array(values.astype(np.float32))
    if kind == "c":
        return pa.StructArray.from_arrays([pa.array(values.real.astype(np.float64)), pa.array(values.imag.astype(np.float64))], ["re", "im"])
    if kind in "Mm":
        return pa.array(values.view(np.int64))
    if kind == "U":
        return pa.array(values.tolist(), pa.string())
    if kind == "S":
        return pa.array(values.tolist(), pa.binary())
    return pa.array(values)
