"""The registered queries of the ingestion engine and the SQL each must equal."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import export
from tessera.operators import parquet as ops
from tessera.operators.arrays import flatten, sum_count
from tessera.plans.reader import read
from tessera.sources.files import scratch

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
DIM = 64


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def _path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


@query("SELECT * FROM nation")
def parquet_scan_nation(spark, sf_dir):
    return read(spark, _path(sf_dir, "nation")).df


@query("SELECT l_orderkey, l_quantity FROM lineitem")
def parquet_project_ci(spark, sf_dir):
    return read(spark, _path(sf_dir, "lineitem"), columns=["L_QUANTITY", "l_orderkey"]).df


@query("SELECT n_name FROM nation")
def parquet_project_ignore_missing(spark, sf_dir):
    return read(spark, _path(sf_dir, "nation"), columns=["n_name", "zzz"]).df


@query("SELECT event_id::DOUBLE AS event_id, epoch_us(ts)::DOUBLE AS ts, user_id::DOUBLE AS user_id, event_type, value, props FROM events")
def parquet_contract_events(spark, sf_dir):
    return read(spark, _path(sf_dir, "events"), contract=True).df


@query(
    "SELECT l_orderkey::DOUBLE AS l_orderkey, l_partkey::DOUBLE AS l_partkey, l_suppkey::DOUBLE AS l_suppkey, l_linenumber, l_quantity, "
    "l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, epoch_us(l_shipdate)::DOUBLE AS l_shipdate FROM lineitem"
)
def parquet_contract_lineitem(spark, sf_dir):
    columns = "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split()
    return read(spark, _path(sf_dir, "lineitem"), contract=True, columns=columns).df


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 5")
def parquet_sample_events(spark, sf_dir):
    return read(spark, _path(sf_dir, "events"), sample=True, sample_by="event_id", columns=["event_id", "user_id", "event_type"]).df


@query("SELECT * FROM region")
def parquet_sample_small_group(spark, sf_dir):
    return read(spark, _path(sf_dir, "region"), sample=True).df


@query(
    "SELECT * FROM (VALUES (0::INTEGER, 'event_id', 'f8', 'INT64'), (1, 'ts', 'f8', 'INT64'), (2, 'user_id', 'f8', 'INT64'), "
    "(3, 'event_type', 'string', 'BYTE_ARRAY'), (4, 'value', 'f8', 'DOUBLE'), (5, 'props', 'string', 'BYTE_ARRAY')) t(pos, name, dtype, parquet_type)"
)
def parquet_inspect_schema(spark, sf_dir):
    return ops.schema_frame(spark, _path(sf_dir, "events"))


@query(
    "WITH f AS (SELECT * FROM customer ORDER BY c_custkey LIMIT 5), n AS (SELECT count(*) AS n FROM customer) "
    "SELECT 'c_custkey' AS name, 'f8' AS dtype, n.n AS length, (SELECT string_agg(c_custkey::VARCHAR, '|' ORDER BY c_custkey) FROM f) AS sample FROM n "
    "UNION ALL SELECT 'c_name', 'string', n.n, (SELECT string_agg(c_name, '|' ORDER BY c_custkey) FROM f) FROM n "
    "UNION ALL SELECT 'c_nationkey', 'i4', n.n, (SELECT string_agg(c_nationkey::VARCHAR, '|' ORDER BY c_custkey) FROM f) FROM n "
    "UNION ALL SELECT 'c_acctbal', 'f8', n.n, (SELECT string_agg(regexp_replace(c_acctbal::VARCHAR, '\\.0$', ''), '|' ORDER BY c_custkey) FROM f) FROM n "
    "UNION ALL SELECT 'c_mktsegment', 'string', n.n, (SELECT string_agg(c_mktsegment, '|' ORDER BY c_custkey) FROM f) FROM n"
)
def parquet_inspect_summary_customer(spark, sf_dir):
    found = read(spark, _path(sf_dir, "customer"), inspect=True)
    return found.summary.select("name", "dtype", "length", F.array_join("sample", "|").alias("sample"))


@query("SELECT count(*) AS row_count, 6 AS column_count, 1 AS row_groups FROM orders")
def parquet_file_metadata(spark, sf_dir):
    found = read(spark, _path(sf_dir, "orders"))
    return spark.createDataFrame([(found.row_count, found.column_count, found.metadata["rowGroups"])], "row_count long, column_count int, row_groups int")


def _with_null(spark, sf_dir, table, column, condition):
    df = read(spark, _path(sf_dir, table)).df
    return df.withColumn(column, F.when(condition, F.lit(None)).otherwise(F.col(column)))


@query("SELECT n_name, coalesce(nullif(n_regionkey, 2), -2147483648) AS n_regionkey FROM nation")
def null_sentinel_int(spark, sf_dir):
    return ops.contract_view(_with_null(spark, sf_dir, "nation", "n_regionkey", F.col("n_regionkey") == 2)).select("n_name", "n_regionkey")


@query("SELECT n_nationkey, coalesce(nullif(n_name, 'FRANCE'), 'null') AS n_name FROM nation")
def null_sentinel_string(spark, sf_dir):
    return ops.contract_view(_with_null(spark, sf_dir, "nation", "n_name", F.col("n_name") == "FRANCE")).select("n_nationkey", "n_name")


@query("SELECT count(*) FILTER (event_type = 'click') AS nans, count(*) AS n FROM events")
def null_sentinel_float_nan(spark, sf_dir):
    view = ops.contract_view(_with_null(spark, sf_dir, "events", "value", F.col("event_type") == "click"))
    return view.agg(F.count_if(F.isnan("value")).alias("nans"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def row_group_merge(spark, sf_dir):
    path = scratch(spark, "groups")
    spark.read.parquet(_path(sf_dir, "orders")).write.option("parquet.block.size", 64 << 10).option("parquet.page.size", 8 << 10).parquet(path)
    return read(spark, path, "parquet", columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]).df


def _embedding_values(spark, sf_dir) -> DataFrame:
    df = spark.read.parquet(_path(sf_dir, "embeddings"))
    return flatten(df, "vec_id", "embedding", DIM)  # vec_id is dense from 0


def _embeddings_npy(spark, sf_dir) -> str:
    path = scratch(spark, "embeddings")
    export.to_npy(_embedding_values(spark, sf_dir), path)
    return path


_FLAT = f"SELECT (vec_id * {DIM} + generate_subscripts(embedding, 1) - 1)::BIGINT AS pos, unnest(embedding) AS \"values\" FROM embeddings"


@query(_FLAT)
def npy_flatten_embeddings(spark, sf_dir):
    return read(spark, _embeddings_npy(spark, sf_dir), "npy").df


@query(_FLAT)
def npy_chunked_embeddings(spark, sf_dir):
    return read(spark, _embeddings_npy(spark, sf_dir), "npy", smallFileMB=0, chunkSizeMB=0.01).df


@query("SELECT round(sum(v::DOUBLE), 4) AS sum, count(*) AS count FROM (SELECT unnest(embedding) AS v FROM embeddings)")
def npy_sum_count(spark, sf_dir):
    values = read(spark, _embeddings_npy(spark, sf_dir), "npy", with_pos=False).df
    return sum_count(values).withColumn("sum", F.round("sum", 4))


def _labels_npz(spark, sf_dir) -> str:
    """A small archive made on the driver: two columns of labels."""
    from pyarrow import fs

    table = spark.read.parquet(_path(sf_dir, "labels")).select("doc_id", "quality").orderBy("doc_id").toArrow()
    raw = io.BytesIO()
    np.savez_compressed(raw, doc_id=table["doc_id"].to_numpy(), quality=table["quality"].to_numpy())
    path = scratch(spark, "labels") + ".npz"
    system, inside = fs.FileSystem.from_uri(path)
    system.create_dir(inside.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(inside) as f:
        f.write(raw.getvalue())
    return path


@query(
    "SELECT 'doc_id' AS name, row_number() OVER (ORDER BY doc_id) - 1 AS pos, doc_id::DOUBLE AS \"values\" FROM labels "
    "UNION ALL SELECT 'quality', row_number() OVER (ORDER BY doc_id) - 1, quality::DOUBLE FROM labels"
)
def npz_members(spark, sf_dir):
    return read(spark, _labels_npz(spark, sf_dir)).df


@query("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, quality AS \"values\" FROM labels")
def npz_select_member(spark, sf_dir):
    return read(spark, _labels_npz(spark, sf_dir)).arrays["quality"].df


_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


def _customer(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(_path(sf_dir, "customer")).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(_CUSTOMER)
def export_csv_roundtrip(spark, sf_dir):
    df, path = _customer(spark, sf_dir), scratch(spark, "csv")
    export.to_csv(df, path)
    return spark.read.schema(df.schema).option("header", True).option("escape", '"').csv(path)


@query(_CUSTOMER)
def export_json_roundtrip(spark, sf_dir):
    df, path = _customer(spark, sf_dir), scratch(spark, "json")
    export.to_json(df, path)
    return spark.read.schema(df.schema).json(path)


@query(_CUSTOMER)
def export_parquet_roundtrip(spark, sf_dir):
    df, path = _customer(spark, sf_dir), scratch(spark, "parquet")
    export.to_parquet(df, path)
    return read(spark, path, "parquet").df


@query("SELECT o_orderkey AS pos, o_totalprice AS \"values\" FROM orders")
def export_npy_roundtrip(spark, sf_dir):
    df = spark.read.parquet(_path(sf_dir, "orders")).select(F.col("o_orderkey").alias("pos"), F.col("o_totalprice").alias("values"))
    path = scratch(spark, "npy")
    export.to_npy(df, path)
    return read(spark, path, "npy").df


@query("SELECT codec, n_nationkey, n_name, n_regionkey FROM nation, (VALUES ('none'), ('snappy'), ('gzip'), ('zstd'), ('lz4')) c(codec)")
def page_codec_matrix(spark, sf_dir):
    df, out = spark.read.parquet(_path(sf_dir, "nation")), None
    for codec in ("none", "snappy", "gzip", "zstd", "lz4"):
        path = scratch(spark, codec)
        export.to_parquet(df, path, compression=codec)
        one = read(spark, path, "parquet").df.select(F.lit(codec).alias("codec"), "n_nationkey", "n_name", "n_regionkey")
        out = one if out is None else out.unionByName(one)
    return out


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)

