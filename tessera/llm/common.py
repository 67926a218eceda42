"""Helpers the operators share: shared storage, checkpoints, text patterns, row identities."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the data contracts.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets an own
    folder (tests); a cluster is refused, since its executors would write where no one else can read."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


#: The tables that cut() has written in the innermost open scratch() block.
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def _note(path: str) -> None:
    own = _scratch.get()
    if own is not None:
        own.append(path)


#: Spark removes the shuffle files of an execution at its end instead of when the driver next collects garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> None:
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEAN, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage: a lost executor costs nothing that was done before.
    A written table rather than checkpoint(): compressed, column-pruned, its size feeds the broadcast decisions, and the
    shuffle files that led to it go at once."""
    spark = df.sparkSession
    path = fresh_path(spark, "cut")
    _write(df, path)
    _note(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that cut() writes in the block are deleted when it ends, so nothing lazy may leave it; what must stay is
    cut() after it."""
    own: list[str] = []
    token = _scratch.set(own)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in own:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        release(spark)


def release(spark: SparkSession) -> None:
    """Let the driver collect its garbage now. Spark frees a broadcast, a shuffle or generated code only when what named
    it has been collected, and asks for that every half hour; many short executions fill the driver long before."""
    spark._jvm.System.gc()


def written(spark: SparkSession, make) -> DataFrame:
    """cut(make()), with the tables that make() wrote on the way deleted."""
    path = fresh_path(spark, "cut")
    with scratch(spark):
        df = make()
        _write(df, path)
    _note(path)
    return spark.read.schema(df.schema).parquet(path)


def whole(text: str | Column = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

