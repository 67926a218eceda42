"""Size-tiered sharding: immutable small shards, merged by size, under a versioned manifest.

append() writes arrivals as small immutable shards and commits a version that adds them. compact() puts the live shards
that are under the target size into tiers by size (a tier spans a factor of FAN), packs shards of a tier into runs of
at most the target size, merges each run of at least two shards into one new file by streaming its row groups (one task
per run, no shuffle, memory of one batch), and commits the version with the merged files in place of their inputs.
It repeats until no tier has a run. A version is a list of parts, JSON lines files of at most PART shards each; a commit
writes only the parts that are new or changed, then the version file that names them, which is created only if its
number is free: of two writers one commits and the other must retry. Files that no version names (of lost or repeated
attempts) are never read. Readers see one version whole.

Rows are kept as they are: nulls, empty and long texts, ties, repeated rows and extra columns go through unchanged. An
empty table appends no shards and commits a version all the same.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh_path

TARGET_BYTES = 32 << 20
ARRIVAL_ROWS = 2000
FAN = 4
#: Shards that a part of the manifest lists at most.
PART = 10_000


class Store:
    """A sharded table under a folder; files are reached through Spark's own file systems on the driver."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _save(self, path: str, text: str) -> bool:
        """Creates the file; False if it is there already."""
        if self._fs.exists(self._path(path)):
            return False
        try:
            out = self._fs.create(self._path(path), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def manifest(self, version: int | None = None) -> dict:
        """version, schema, parts (names) and shards (file and bytes of each live shard)."""
        have = self.versions()
        if not have:
            return {"version": -1, "schema": None, "parts": [], "shards": []}
        out = json.loads(self._load(f"{self.root}/versions/{have[-1] if version is None else version:08d}.json"))
        out["shards"] = [s | {"part": p} for p in out["parts"] for s in map(json.loads, self._load(f"{self.root}/parts/{p}").splitlines())]
        return out

    def commit(self, last: dict, schema: str | None, gone: set[str], new: list[dict]) -> int:
        """The version after `last`, without the shards of the files in `gone` and with the new ones. Parts without a
        change are kept by name. Atomic: fails if the version is there already."""
        import uuid

        if last["version"] + 1 in self.versions():
            raise RuntimeError(f"version {last['version'] + 1} is committed already")
        changed = {s["part"] for s in last["shards"] if s["file"] in gone}
        fresh = [s for s in last["shards"] if s["part"] in changed and s["file"] not in gone] + new
        parts = [p for p in last["parts"] if p not in changed]
        for lo in range(0, len(fresh), PART):
            name = f"{uuid.uuid4().hex}.jsonl"
            self._save(f"{self.root}/parts/{name}", "\n".join(json.dumps({"file": s["file"], "bytes": s["bytes"]}) for s in fresh[lo : lo + PART]))
            parts.append(name)
        version = last["version"] + 1
        if not self._save(f"{self.root}/versions/{version:08d}.json", json.dumps({"version": version, "schema": schema, "parts": parts})):
            raise RuntimeError(f"version {version} is committed already")
        return version

    def _written(self, folder: str) -> list[dict]:
        path = self._path(folder)
        found = [s for s in self._fs.listStatus(path)] if self._fs.exists(path) else []
        return sorted(({"file": s.getPath().toString(), "bytes": s.getLen()} for s in found if s.getPath().getName().endswith(".parquet")), key=lambda x: x["file"])

    def append(self, rows: DataFrame, arrival_rows: int = ARRIVAL_ROWS) -> int:
        """Each task's rows become shards of at most arrival_rows rows, without a shuffle."""
        import uuid

        last = self.manifest()
        folder = f"{self.root}/arrivals-{uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", arrival_rows).option("compression", "zstd").parquet(folder)
        return self.commit(last, rows.schema.json(), set(), self._written(folder))

    def plan(self, target: int = TARGET_BYTES) -> list[list[dict]]:
        """Runs to merge. Within a tier, shards go in order of size and name; a run is closed at the target size."""
        tiers: dict[int, list[dict]] = {}
        for s in self.manifest()["shards"]:
            if s["bytes"] < target / 2:
                tiers.setdefault(int(math.log(max(1, s["bytes"]), FAN)), []).append(s)
        runs = []
        for tier in sorted(tiers):
            run, size = [], 0
            for s in sorted(tiers[tier], key=lambda x: (x["bytes"], x["file"])):
                if run and size + s["bytes"] > target:
                    runs.append(run)
                    run, size = [], 0
                run, size = [*run, s], size + s["bytes"]
            runs.append(run)
        return [r for r in runs if len(r) >= FAN] or [r for r in runs if len(r) >= 2]

    def compact(self, target: int = TARGET_BYTES) -> int:
        """Merges until no tier has a run; returns the last version. The runs are metadata: names and sizes of files."""
        while runs := self.plan(target):
            last = self.manifest()
            folder = f"{self.root}/merged-v{last['version'] + 1}"
            rows = [(k, [s["file"] for s in run]) for k, run in enumerate(runs)]
            work = self.spark.createDataFrame(rows, "run int, files array<string>").repartition(len(rows))  # round robin: a run a task
            merged = [r.asDict() for r in work.mapInArrow(_merger(folder), "file string, bytes long").collect()]
            gone = {s["file"] for run in runs for s in run}
            self.commit(last, last["schema"], gone, sorted(merged, key=lambda x: x["file"]))
        return self.manifest()["version"]

    def read(self, version: int | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        m = self.manifest(version)
        schema = StructType.fromJson(json.loads(m["schema"]))
        files = [s["file"] for s in m["shards"]]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)


def _merger(folder: str):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            for files in batch.column(1).to_pylist():
                system, _ = fs.FileSystem.from_uri(folder)
                inside = [fs.FileSystem.from_uri(f)[1] for f in files]
                base = fs.FileSystem.from_uri(folder)[1]
                system.create_dir(base, recursive=True)
                name = f"shard-{uuid.uuid4().hex}.parquet"
                writer = None
                for path in inside:
                    with system.open_input_file(path) as f:
                        part = pq.ParquetFile(f)
                        if writer is None:
                            sink = system.open_output_stream(f"{base}/{name}")
                            writer = pq.ParquetWriter(sink, part.schema_arrow, compression="zstd")
                        for own in part.iter_batches(batch_size=2000):
                            writer.write_batch(own)
                writer.close()
                sink.close()
                size = system.get_file_info(f"{base}/{name}").size
                yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "bytes": [size]})

    return merge


def sharded(docs: DataFrame, target: int = TARGET_BYTES, arrival_rows: int = ARRIVAL_ROWS) -> DataFrame:
    """docs appended to a fresh store, compacted, and read back: its columns; _shard, the file of each row; and _bytes,
    the size that the last version lists for that file, null if it lists none."""
    spark = docs.sparkSession
    store = Store(spark, fresh_path(spark, "shards"))
    store.append(docs, arrival_rows)
    store.compact(target)
    live = [(s["file"].rsplit("/", 1)[1], s["bytes"]) for s in store.manifest()["shards"]]
    sizes = spark.createDataFrame(live, "_shard string, _bytes long")
    rows = store.read().withColumn("_shard", F.regexp_extract(F.col("_metadata.file_path"), "[^/]+$", 0))
    return rows.join(F.broadcast(sizes) if len(live) <= PART else sizes, "_shard", "left")
