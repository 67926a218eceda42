"""Bytes of files: through Spark's file systems on the driver, through pyarrow's in tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder in the storage that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def data_files(spark: SparkSession, path: str, suffix: str = ".parquet") -> list[tuple[str, int]]:
    """(uri, size) of a file, or of the data files right under a folder and its partition folders (name=value), by name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.getFileStatus(p)
    if status.isFile():
        return [(status.getPath().toString(), status.getLen())]
    out, folders = [], [p]
    while folders:
        for s in fs.listStatus(folders.pop()):
            name = s.getPath().getName()
            if name.startswith(("_", ".")):
                continue
            if s.isFile() and name.endswith(suffix):
                out.append((s.getPath().toString(), s.getLen()))
            elif s.isDirectory() and "=" in name:
                folders.append(s.getPath())
    return sorted(out)


def read_range(spark: SparkSession, path: str, start: int, size: int) -> bytes:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        stream.seek(start)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size))
    finally:
        stream.close()


def open_in_task(path: str):
    """A seekable file for a Python worker. (system, path inside, open file)."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, inside = fs.FileSystem.from_uri(path)
    return system.open_input_file(inside)


def names_in_task(path: str, suffix: str) -> list[str]:
    """The file itself, or the files with the suffix right under the folder, by name."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    system, inside = fs.FileSystem.from_uri(path)
    info = system.get_file_info(inside)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    scheme = path[: len(path) - len(path.split("://", 1)[-1])] if "://" in path else ""
    found = system.get_file_info(fs.FileSelector(inside))
    host = "" if not scheme or scheme == "file://" else path.split("://", 1)[1].split("/", 1)[0]
    prefix = "file://" if not scheme or scheme == "file://" else scheme + ("" if inside.startswith(host) else host)
    return sorted(prefix + f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(suffix) and not f.base_name.startswith(("_", ".")))
