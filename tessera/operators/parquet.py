"""Parquet operators: projection, per-row-group sample, contract view, inspection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.formatting import value_text
from tessera.functions.types import SENTINELS
from tessera.sources.footer import Footer, read_footer

SAMPLE_ROWS = 5
#: Row groups up to which the sample is one pushed-down predicate; beyond, a broadcast join on the wanted positions.
PREDICATE_GROUPS = 200


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def scan(spark: SparkSession, path: str, footer: Footer) -> DataFrame:
    """Spark's own reader. What needs a session setting to be read says so, rather than failing late."""
    names = [c.name.lower() for c in footer.columns]
    if len(set(names)) < len(names) and spark.conf.get("spark.sql.caseSensitive") != "true":
        raise ValueError("column names differ only in case: set spark.sql.caseSensitive=true")
    if any("BYTE_STREAM_SPLIT" in c.encodings for c in footer.columns) and spark.conf.get("spark.sql.parquet.enableVectorizedReader") == "true":
        raise ValueError("BYTE_STREAM_SPLIT pages: set spark.sql.parquet.enableVectorizedReader=false")
    if any(c.compression in ("BROTLI", "LZO") for c in footer.columns):
        raise ValueError("BROTLI and LZO pages need a codec that Spark does not ship")
    old = {c.name for c in footer.columns if c.parquet_type == "INT96"}  # Spark reads these as they are
    for field in footer.schema:
        if field.name not in old and str(field.type).startswith("timestamp[ns") and spark.conf.get("spark.sql.legacy.parquet.nanosAsLong", "false") != "true":
            raise ValueError(f"{field.name}: nanosecond timestamps: set spark.sql.legacy.parquet.nanosAsLong=true")
    return spark.read.parquet(path)


def project(df: DataFrame, columns: list[str] | None, on_missing: str = "ignore") -> DataFrame:
    """Columns by name in any case: file order, file spelling, repeats once; an empty list means all."""
    if not columns:
        return df
    wanted = {c.lower() for c in columns}
    if on_missing == "error" and (gone := wanted - {c.lower() for c in df.columns}):
        raise ValueError(f"no column {', '.join(sorted(gone))}")
    return df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() in wanted])


def sample(df: DataFrame, footer: Footer, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows of each row group. df: a scan of the footer's files, not yet projected."""
    index, file = F.col("_metadata.row_index"), F.col("_metadata.file_name")
    starts = []
    for name, groups in footer.files:
        at = 0
        for n in groups:
            starts.append((name.rsplit("/", 1)[-1], at, min(rows, n)))
            at += n
    if len(starts) <= PREDICATE_GROUPS:
        one = len(footer.files) == 1
        inside = [index.between(at, at + n - 1) & (F.lit(True) if one else file == name) for name, at, n in starts if n]
        return df.where(reduce(lambda a, b: a | b, inside, F.lit(False)))
    spark = df.sparkSession
    wanted = spark.createDataFrame(starts, "_file string, _at long, _n int").select("_file", F.explode(F.expr("sequence(_at, _at + _n - 1)")).alias("_index"))
    # Five rows a group: a fraction of the footers that the driver has just read.
    keyed = df.withColumns({"_file": file, "_index": index})
    return keyed.join(F.broadcast(wanted), ["_file", "_index"], "left_semi").drop("_file", "_index")


def first_by(df: DataFrame, column: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows of the whole table in order of a column, nulls last, ties in file order, however its row groups lie.
    df: a scan, not yet projected."""
    place = [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
    return df.orderBy(F.col(quoted(column)).asc_nulls_last(), *place).limit(rows)


def contract_column(name: str, kind: T.DataType, nulls: bool = True, millis: bool = False) -> Column | None:
    """The column as the result contract has it, times in the unit of the file (millis or micros); None where the contract has no data (nested and fixed-length)."""
    c = F.col(quoted(name))
    if isinstance(kind, T.BooleanType):
        c, dtype = c.cast("short"), "u1"
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
        c, dtype = c.cast("int"), "i4"
    elif isinstance(kind, T.DateType):
        c, dtype = F.unix_date(c), "i4"
    elif isinstance(kind, T.LongType):
        c, dtype = c.cast("double"), "f8"
    elif isinstance(kind, T.FloatType):
        dtype = "f4"
    elif isinstance(kind, T.DoubleType):
        dtype = "f8"
    elif isinstance(kind, T.TimestampNTZType):
        c, dtype = F.expr(f"cast(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {quoted(name)}) AS double)"), "f8"
    elif isinstance(kind, T.TimestampType):
        c, dtype = F.unix_micros(c).cast("double"), "f8"
    elif isinstance(kind, T.DecimalType) and kind.precision <= 18:
        c, dtype = (c * F.lit(10**kind.scale)).cast("decimal(38,0)").cast("int" if kind.precision <= 9 else "double"), "i4" if kind.precision <= 9 else "f8"
    elif isinstance(kind, T.DecimalType) and kind.precision == 20 and kind.scale == 0:
        c, dtype = c.cast("double"), "f8"
    elif isinstance(kind, T.StringType):
        dtype = "string"
    elif isinstance(kind, T.BinaryType):
        c, dtype = F.make_valid_utf8(c.cast("string")), "string"
    else:
        return None
    if millis and isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.floor(c / 1000).cast("double")
    if nulls:
        fill = F.lit(SENTINELS[dtype])
        c = F.coalesce(c, {"u1": fill.cast("short"), "f4": fill.cast("float")}.get(dtype, fill))
    return c.alias(name)


def millis_columns(footer: Footer) -> frozenset[str]:
    """Columns whose file keeps times in milliseconds."""
    return frozenset(f.name for f in footer.schema if str(f.type).startswith("timestamp[ms"))


def contract_view(df: DataFrame, null_policy: str = "sentinel", millis: frozenset[str] = frozenset()) -> DataFrame:
    """A projection: integers of 64 bits and times as doubles, booleans as 0 and 1, nulls as in-band sentinels
    (null_policy='null' keeps them). Times are micros, those of the columns in `millis` milliseconds."""
    if null_policy not in ("sentinel", "null"):
        raise ValueError(f"null_policy {null_policy}")
    made = [contract_column(f.name, f.dataType, null_policy == "sentinel", f.name in millis) for f in df.schema]
    return df.select(*[c for c in made if c is not None])


def summary(spark: SparkSession, path: str, footer: Footer, columns: list[str] | None = None) -> DataFrame:
    """One row per column: pos, name, dtype, length, sample (the first values as text), parquet_type, encoding,
    compression. Five rows of the file reach the driver."""
    df = scan(spark, path, footer)
    names = project(df, columns).columns
    first = df.where(F.col("_metadata.row_index") < SAMPLE_ROWS) if footer.files else df
    if len(footer.files) > 1:
        first = first.where(F.col("_metadata.file_name") == footer.files[0][0].rsplit("/", 1)[-1])
    ordered = first.select(F.col("_metadata.row_index").alias("_at"), "*")
    shown = contract_view(project(ordered, ["_at", *names]), millis=millis_columns(footer))
    rows = sorted(shown.collect(), key=lambda r: r["_at"])
    has, out = set(shown.columns), []
    for pos, c in enumerate(c for c in footer.columns if c.name in names):
        held = c.name in has and c.dtype != "unknown"
        text = [value_text(r[c.name]) for r in rows] if held else ["[missing column data]"]
        out.append((pos, c.name, c.dtype, footer.row_count if held else 0, text, c.parquet_type, c.encoding, c.compression))
    return spark.createDataFrame(out, "pos int, name string, dtype string, length long, sample array<string>, parquet_type string, encoding string, compression string")


def schema_frame(spark: SparkSession, path: str) -> DataFrame:
    footer = read_footer(spark, path)
    rows = [(k, c.name, c.dtype, c.parquet_type) for k, c in enumerate(footer.columns)]
    return spark.createDataFrame(rows, "pos int, name string, dtype string, parquet_type string")
