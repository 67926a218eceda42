"""Spark data sources for NumPy arrays ('npy') and archives ('npz').

A payload is cut into element ranges, one partition each, that stream Arrow batches; nothing reads a whole file at once.
A deflated archive member cannot be entered in the middle, so an archive is planned with one partition per member.
"""

from __future__ import annotations

import ast
import math
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib import format as npy_format
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.functions.types import arrow_values, spark_type
from tessera.sources.files import names_in_task, open_in_task

SMALL_FILE_BYTES = 16 << 20
CHUNK_BYTES = 64 << 20
BATCH_ELEMENTS = 1_000_000


@dataclass(frozen=True)
class Header:
    descr: str
    shape: tuple[int, ...]
    fortran: bool
    offset: int

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(self.descr)

    @property
    def count(self) -> int:
        return math.prod(self.shape)


def parse_header(f) -> Header:
    """The header of an open .npy stream, at its start."""
    if (magic := f.read(6)) != npy_format.MAGIC_PREFIX:
        raise ValueError(f"Invalid NPY file: bad magic {magic!r}")
    major, _ = f.read(2)
    size = int.from_bytes(f.read(2 if major == 1 else 4), "little")
    raw = f.read(size)
    start = 8 + (2 if major == 1 else 4) + size
    try:
        fields = ast.literal_eval(raw.decode("utf-8" if major >= 3 else "latin-1"))
        shape, fortran, dtype = fields["shape"], fields["fortran_order"], np.dtype(fields["descr"])
        if not (isinstance(shape, tuple) and all(isinstance(n, int) and n >= 0 for n in shape)):
            raise ValueError(f"shape {shape}")
    except (ValueError, KeyError, SyntaxError, TypeError) as e:
        raise ValueError(f"Invalid NPY header: {e}") from e
    if dtype.names or dtype.hasobject:
        raise ValueError("Invalid NPY header: structured and object dtypes are not supported")
    return Header(dtype.str, tuple(shape), bool(fortran), start)


def header_of(path: str) -> Header:
    with open_in_task(path) as f:
        return parse_header(f)


def _rows(values: np.ndarray, start: int, with_pos: bool, name: str | None = None) -> pa.RecordBatch:
    columns, names = [arrow_values(values)], ["values"]
    if with_pos:
        columns.insert(0, pa.array(np.arange(start, start + len(values), dtype=np.int64)))
        names.insert(0, "pos")
    if name is not None:
        columns.insert(0, pa.array([name] * len(values), pa.string()))
        names.insert(0, "name")
    return pa.RecordBatch.from_arrays(columns, names)


def c_order(header: Header, start: int, stop: int) -> np.ndarray:
    """Storage positions of the elements start..stop-1 in C order of a Fortran-ordered array."""
    index = np.unravel_index(np.arange(start, stop), header.shape, order="C")
    return np.ravel_multi_index(index, header.shape, order="F")


@dataclass
class Range(InputPartition):
    path: str
    first: int
    start: int
    stop: int


class NpySource(DataSource):
    """Options: path (a file or a folder of files with one dtype, by name), smallFileBytes, chunkBytes, numPartitions,
    withPos ('false' leaves pos out), order ('storage', or 'C' for the logical order of Fortran arrays)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> T.StructType:
        paths = names_in_task(self.options["path"], ".npy")
        if not paths:
            raise ValueError(f"no .npy file in {self.options['path']}")
        fields = [T.StructField("values", spark_type(header_of(paths[0]).dtype))]
        if self.options.get("withPos", "true").lower() != "false":
            fields.insert(0, T.StructField("pos", T.LongType()))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return NpyReader(dict(self.options), "pos" in schema.names)


class NpyReader(DataSourceReader):
    def __init__(self, options: dict, with_pos: bool) -> None:
        low = {k.lower(): v for k, v in options.items()}
        self.path, self.with_pos = low["path"], with_pos
        self.small, self.chunk = int(low.get("smallfilebytes", SMALL_FILE_BYTES)), int(low.get("chunkbytes", CHUNK_BYTES))
        self.parts, self.logical = int(low.get("numpartitions", 0)), low.get("order", "storage") == "C"

    def partitions(self) -> list[InputPartition]:
        out, first, kind = [], 0, None
        for path in names_in_task(self.path, ".npy"):
            h = header_of(path)
            if kind is not None and h.dtype != kind:
                raise ValueError(f"{path}: dtype {h.descr} differs from {kind.str}")
            kind = h.dtype
            with open_in_task(path) as f:
                if f.size() < h.offset + h.count * h.dtype.itemsize:
                    raise ValueError(f"{path}: payload is shorter than its shape {h.shape}")
            size = h.count * h.dtype.itemsize
            n = self.parts or (1 if size < self.small else -(-size // self.chunk))
            step = max(1, -(-h.count // n))
            out += [Range(path, first, k, min(k + step, h.count)) for k in range(0, h.count, step)]
            first += h.count
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.start == partition.stop:
            return
        with open_in_task(partition.path) as f:
            h = parse_header(f)
            size = h.dtype.itemsize
            if self.logical and h.fortran and len(h.shape) > 1:
                f.seek(h.offset)
                stored = np.frombuffer(f.read(h.count * size), h.dtype)
                for k in range(partition.start, partition.stop, BATCH_ELEMENTS):
                    stop = min(k + BATCH_ELEMENTS, partition.stop)
                    yield _rows(stored[c_order(h, k, stop)], partition.first + k, self.with_pos)
                return
            f.seek(h.offset + partition.start * size)
            for k in range(partition.start, partition.stop, BATCH_ELEMENTS):
                n = min(BATCH_ELEMENTS, partition.stop - k)
                yield _rows(np.frombuffer(f.read(n * size), h.dtype), partition.first + k, self.with_pos)


def chunks(path: str, elements: int = BATCH_ELEMENTS) -> Iterator[np.ndarray]:
    """An array file's elements in storage order, so many at a time."""
    with open_in_task(path) as f:
        h = parse_header(f)
        for k in range(0, h.count, elements):
            yield np.frombuffer(f.read(min(elements, h.count - k) * h.dtype.itemsize), h.dtype)


@dataclass(frozen=True)
class Member:
    name: str
    entry: str
    header: Header


def members(path: str) -> list[Member]:
    """The arrays of an archive in archive order; of entries of one name the last is read under each."""
    with open_in_task(path) as f, zipfile.ZipFile(f) as z:
        own = [i for i in z.infolist() if i.filename.endswith(".npy")]
        for i in z.infolist():
            if i.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
                raise ValueError(f"Unsupported ZIP compression method: {i.compress_type}")
        out = []
        for i in own:
            with z.open(i.filename) as m:
                out.append(Member(i.filename[:-4], i.filename, parse_header(m)))
        return out


@dataclass
class Entry(InputPartition):
    name: str


class NpzSource(DataSource):
    """Options: path, member (one array with its exact type; without it all arrays in long form, values as double)."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> T.StructType:
        member, kind = self.options.get("member"), T.DoubleType()
        if member:
            found = [m for m in members(self.options["path"]) if m.name == member]
            if not found:
                raise ValueError(f"no array {member} in {self.options['path']}")
            kind = spark_type(found[-1].header.dtype)
        return T.StructType([T.StructField("name", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("values", kind)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return NpzReader(self.options["path"], self.options.get("member"))


class NpzReader(DataSourceReader):
    def __init__(self, path: str, member: str | None) -> None:
        self.path, self.member = path, member

    def partitions(self) -> list[InputPartition]:
        names = dict.fromkeys(m.name for m in members(self.path) if self.member in (None, m.name))
        return [Entry(n) for n in names] or [Entry("")]

    def read(self, partition: Entry) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        with open_in_task(self.path) as f, zipfile.ZipFile(f) as z, z.open(f"{partition.name}.npy") as m:
            h = parse_header(m)
            for k in range(0, h.count, BATCH_ELEMENTS):
                n = min(BATCH_ELEMENTS, h.count - k)
                raw = m.read(n * h.dtype.itemsize)
                if len(raw) < n * h.dtype.itemsize:
                    raise ValueError(f"{partition.name}: payload is shorter than its shape {h.shape}")
                values = np.frombuffer(raw, h.dtype)
                yield _rows(values if self.member else values.astype(np.float64), k, True, partition.name)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpySource)
    spark.dataSource.register(NpzSource)
