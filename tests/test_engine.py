"""Engine operators against NumPy, pyarrow and DuckDB."""

import io
import zipfile
from glob import glob

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from tessera.functions.formatting import number_text, value_text
from tessera.functions.types import contract_dtype, itemsize, normalized
from tessera.plans import catalog
from tessera.plans.reader import read
from tessera.sources import numpy_files

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {f.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{f}'")
    got = catalog.queries()[name](spark, SF).toPandas()
    want = con.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("kind", ["<f4", "<f8", "i1", "<i2", "<i4", "u1", "<u2", "<u4", "?", ">i4", "<i8", "<f2", "<u8", "<U4"])
def test_npy_types(spark, tmp_path, kind):
    a = (np.arange(7) % 2).astype(kind) if kind == "?" else np.arange(7).astype(kind)
    np.save(tmp_path / "a.npy", a)
    r = read(spark, f"{tmp_path}/a.npy", chunkSizeMB=0.00001, smallFileMB=0)
    got = [x["values"] for x in r.df.orderBy("pos").collect()]
    assert [str(x) for x in got] == [str(x) for x in a.astype(a.dtype.newbyteorder("=")).tolist()]
    assert r.row_count == 7 and r.shape == (7,)


def test_npy_shapes(spark, tmp_path):
    f = np.asfortranarray(np.arange(6.0).reshape(2, 3))
    np.save(tmp_path / "f.npy", f)
    np.save(tmp_path / "s.npy", np.float64(5))
    np.save(tmp_path / "e.npy", np.zeros(0))
    values = lambda **o: [x["values"] for x in read(spark, f"{tmp_path}/f.npy", **o).df.orderBy("pos").collect()]
    assert values() == f.ravel("K").tolist() and values(order="C") == f.ravel("C").tolist()
    r = read(spark, f"{tmp_path}/f.npy")
    assert r.metadata == {"fortranOrder": True, "originalShape": (2, 3), "ndim": 2, "elementSize": 8}
    assert read(spark, f"{tmp_path}/s.npy").df.count() == 1 and read(spark, f"{tmp_path}/e.npy").df.count() == 0
    assert sum(len(c) for c in numpy_files.chunks(f"{tmp_path}/f.npy", 4)) == 6


def test_npy_errors(spark, tmp_path):
    (tmp_path / "bad.npy").write_bytes(b"nonsense")
    np.save(tmp_path / "struct.npy", np.zeros(2, [("a", "<i4")]))
    np.save(tmp_path / "short.npy", np.arange(9.0))
    raw = (tmp_path / "short.npy").read_bytes()
    (tmp_path / "short.npy").write_bytes(raw[:-8])
    for name, text in (("bad", "magic"), ("struct", "structured")):
        with pytest.raises(ValueError, match=text):
            read(spark, f"{tmp_path}/{name}.npy")
    with pytest.raises(Exception, match="shorter"):
        read(spark, f"{tmp_path}/short.npy").df.count()
    with pytest.raises(ValueError, match="Unsupported format: xyz"):
        read(spark, "a.xyz")


def test_npz(spark, tmp_path):
    np.savez_compressed(tmp_path / "z.npz", a=np.arange(3, dtype="<i4"), b=np.array([1.5]))
    with zipfile.ZipFile(tmp_path / "z.npz", "a") as z:
        z.writestr("readme.txt", "no array")
    r = read(spark, f"{tmp_path}/z.npz")
    assert r.names == ["a", "b"] and r.metadata["entryCount"] == 2
    assert [x["values"] for x in r.arrays["a"].df.orderBy("pos").collect()] == [0, 1, 2]
    assert r.df.count() == 4
    with zipfile.ZipFile(tmp_path / "c.npz", "w", zipfile.ZIP_BZIP2) as z:
        raw = io.BytesIO()
        np.save(raw, np.arange(2))
        z.writestr("a.npy", raw.getvalue())
    with pytest.raises(ValueError, match="Unsupported ZIP"):
        read(spark, f"{tmp_path}/c.npz")


def test_parquet_groups_nulls_and_inspect(spark, tmp_path):
    t = pa.table({"I": pa.array([None, 5] + list(range(21)), pa.int32()), "s": pa.array(["x", None] + ["é"] * 21), "b": pa.array([True, None] + [False] * 21), "n": pa.array([[1.0]] * 23)})
    pq.write_table(t, tmp_path / "g.parquet", row_group_size=10)
    r = read(spark, f"{tmp_path}/g.parquet", sample=True, columns=["i", "S", "zzz"])
    assert r.df.columns == ["I", "s"] and r.df.count() == 13 and r.row_count == 23 and r.metadata["returnedRows"] == 13
    view = read(spark, f"{tmp_path}/g.parquet", contract=True).df
    assert view.columns == ["I", "s", "b"]
    assert view.where("I = -2147483648 AND b = 1").count() == 1 and view.where("s = 'null' AND b = 255").count() == 1
    found = read(spark, f"{tmp_path}/g.parquet", inspect=True)
    rows = {x["name"]: x for x in found.summary.collect()}
    assert rows["I"]["sample"] == ["-2147483648", "5", "0", "1", "2"] and rows["n"]["sample"] == ["[missing column data]"]
    assert found.metadata["rowGroups"] == 3
    (tmp_path / "bad.parquet").write_text("not parquet at all")
    with pytest.raises(ValueError, match="Invalid Parquet"):
        read(spark, f"{tmp_path}/bad.parquet")
    with pytest.raises(ValueError, match="zzz"):
        read(spark, f"{tmp_path}/g.parquet", columns=["zzz"], on_missing="error")


@pytest.mark.parametrize("x,text", [(5.0, "5"), (-0.0, "0"), (0.1, "0.1"), (1e-6, "0.000001"), (1e-7, "1e-7"), (1e21, "1e+21"), (123456789012345680000.0, "123456789012345680000"), (float("inf"), "NaN"), (-1234.5, "-1234.5")])
def test_number_text(x, text):
    assert number_text(x) == text


def test_helpers():
    assert value_text(None) == "null" and value_text(True) == "true" and value_text([1]) == "[1]"
    assert normalized("<f8") == "f8" and normalized("") == "unknown" and itemsize("<f4") == 4
    assert contract_dtype("INT64") == "f8" and contract_dtype("INT96") == "unknown"


def test_times_in_the_unit_of_the_file(spark, tmp_path):
    table = pa.table({"ms": pa.array([1000, None, -1], pa.timestamp("ms")), "us": pa.array([1000, None, -1], pa.timestamp("us"))})
    pq.write_table(table, tmp_path / "t.parquet")
    got = read(spark, f"{tmp_path}/t.parquet", contract=True, null_policy="null").df.collect()
    assert [(r.ms, r.us) for r in got] == [(1000.0, 1000.0), (None, None), (-1.0, -1.0)]


def test_int96_and_partitioned_folders(spark, tmp_path):
    import datetime

    at = datetime.datetime(2020, 1, 2, 3, 4, 5)
    pq.write_table(pa.table({"t": pa.array([at], pa.timestamp("ns"))}), tmp_path / "old.parquet", use_deprecated_int96_timestamps=True)
    assert [r.t.replace(tzinfo=None) for r in read(spark, f"{tmp_path}/old.parquet").df.collect()] == [at]
    spark.range(10).selectExpr("id", "id % 3 AS k", "id % 2 AS j").write.partitionBy("k", "j").parquet(f"{tmp_path}/parts.parquet")
    whole = read(spark, f"{tmp_path}/parts.parquet", "parquet")
    assert whole.row_count == 10 and sorted((r.id, r.k, r.j) for r in whole.df.collect()) == [(i, i % 3, i % 2) for i in range(10)]


def test_sample_in_order_of_a_column_over_row_groups(spark, tmp_path):
    events = pq.read_table(f"{SF}/events.parquet")
    backwards = events.take(pa.array(range(events.num_rows - 1, -1, -1)))
    (tmp_path / "sf").mkdir()
    pq.write_table(backwards, tmp_path / "sf" / "events.parquet", row_group_size=100)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/sf/events.parquet'")
    want = con.execute(catalog.oracle_sql()["parquet_sample_events"]).fetchall()
    assert [tuple(r) for r in catalog.queries()["parquet_sample_events"](spark, f"{tmp_path}/sf").collect()] == want
    pq.write_table(pa.table({"k": [None, 3, 1, 2, 1, None, 0], "v": range(7)}), tmp_path / "k.parquet", row_group_size=2)
    r = read(spark, f"{tmp_path}/k.parquet", sample=True, sample_by="K", columns=["v"])
    assert [x.v for x in r.df.collect()] == [6, 2, 4, 3, 1] and r.metadata["returnedRows"] == 5
