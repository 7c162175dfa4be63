"""Table scans with the tolerance rules of survey and raster archives."""
from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed sentinel values that mean "no data" in the climate layers.
SENTINELS = (-9999.0, -999.0, -99.0)

#: Largest Parquet file taken for one that holds a footer only.
EMPTY_BYTES = 1 << 20


def scan_csv(spark: SparkSession, paths: Sequence[str], schema: str, columns: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """Many CSV files as one table; unread columns are never parsed."""
    return (
        spark.read.schema(schema)
        .options(header=True, encoding=encoding, mode="PERMISSIVE", enforceSchema=False)
        .csv(list(paths))
        .select(*columns)
    )


def list_files(spark: SparkSession, paths: Sequence[str], glob: str | None = None) -> DataFrame:
    """(path, length) of every file without reading its bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(list(paths)).select("path", "length")


def _plain_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "/")


def _file_path() -> Column:
    """Path of the file a row came from, as listings write it."""
    return _plain_path(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))


def _first_lines(spark: SparkSession, paths: Sequence[str], glob: str) -> DataFrame:
    """(path, header): first line of every file that has one."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(list(paths))
    # a header stands in the first split; each task keeps one line per file before the shuffle
    heads = lines.where(F.col("_metadata.file_block_start") == 0).select("value", _file_path().alias("path"), F.monotonically_increasing_id().alias("n"))
    return heads.groupBy("path").agg(F.min_by("value", "n").alias("header"))


def scan_csv_tolerant(spark: SparkSession, paths: Sequence[str], columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped): files whose first line lacks a wanted column are left out and listed (files of no bytes are no
    files to Spark).

    The first line alone decides, read as CSV (names may stand in quotes, with commas inside). Distinct headers reach
    the driver with their files; files with the same header are read together. All values stay strings, see
    :func:`coerce_keys`.
    """
    by_header: dict[tuple, list[str]] = {}
    for row in _first_lines(spark, paths, "*.csv").collect():
        names = [n.strip() for n in next(csv.reader([row["header"].lstrip("\ufeff")], skipinitialspace=True), [])]
        if set(columns) <= set(names):
            by_header.setdefault(tuple(names), []).append(row["path"])
    rows = None
    for header in sorted(by_header):
        schema = ", ".join("`" + name.replace("`", "``") + "` STRING" for name in header)
        part = scan_csv(spark, by_header[header], schema, columns)
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        raise ValueError("no file has the wanted columns")
    good = spark.createDataFrame([(p,) for found in by_header.values() for p in found], "path STRING")
    files = list_files(spark, paths, "*.csv").select(_plain_path(F.col("path")).alias("path"))
    return rows, files.join(good, "path", "left_anti")


def scan_parquet_tolerant(spark: SparkSession, paths: Sequence[str], schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped): Parquet files give what can be read; files that can't be read whole are listed.

    A file is whole when decoding all columns gives as many rows as its footer states (the count without columns).
    A valid file without rows is not listed: files up to ``EMPTY_BYTES`` that gave nothing show their footer.
    Counting decodes the data once more, when ``skipped`` is asked for.
    """
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).parquet(*paths)
    stated = rows.groupBy(_file_path().alias("path")).agg(F.count("*").alias("_stated"))
    decoded = rows.groupBy(_file_path().alias("path")).agg(F.count("*").alias("_read"), *[F.count(c).alias(f"_n{i}") for i, c in enumerate(rows.columns)])
    small = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths)).where(F.col("length") <= EMPTY_BYTES)

    def empty(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["path"]][[_states_no_rows(c) for c in batch["content"]]]

    valid = small.select("path", "content").mapInPandas(empty, "path STRING").select(_plain_path(F.col("path")).alias("path"))
    files = list_files(spark, paths).select(_plain_path(F.col("path")).alias("path"))
    checked = files.join(stated, "path", "left").join(decoded, "path", "left")
    # naming every count keeps all columns in the scan
    wrong = F.col("_read") != F.col("_stated")
    for i in range(len(rows.columns)):
        wrong = wrong | (F.col(f"_n{i}") > F.col("_stated"))
    broken = checked.where(F.coalesce(wrong, F.lit(True))).select("path")
    return rows, broken.join(valid, "path", "left_anti")


def _states_no_rows(content: bytes) -> bool:
    try:
        return pq.read_metadata(io.BytesIO(content)).num_rows == 0
    except (pa.ArrowException, OSError):
        return False


def scan_csv_any_charset(spark: SparkSession, paths: Sequence[str], schema: str) -> DataFrame:
    """UTF-8 per file, Latin-1 for every file that is not valid UTF-8.

    Latin-1 maps each byte to one character, so one scan recovers the bytes; a file is
    UTF-8 only when all its fields are.
    """
    raw = spark.read.schema(schema).options(header=True, encoding="ISO-8859-1").csv(list(paths))
    texts = [f.name for f in raw.schema if f.dataType.simpleString() == "string"]
    raw = raw.withColumn("_file", F.col("_metadata.file_path"))

    def as_utf8(c: str) -> Column:
        return F.encode(F.col(c), "ISO-8859-1").cast("string")

    ok = F.lit(True)
    for c in texts:
        ok = ok & F.coalesce(F.is_valid_utf8(as_utf8(c)), F.lit(True))
    valid = raw.groupBy("_file").agg(F.bool_and(ok).alias("_utf8"))
    joined = raw.join(valid, "_file")
    for c in texts:
        joined = joined.withColumn(c, F.when(F.col("_utf8"), as_utf8(c)).otherwise(F.col(c)))
    return joined.drop("_file", "_utf8")


def coerce_keys(df: DataFrame, keys: Sequence[str], values: Sequence[str] = ()) -> DataFrame:
    """Unparseable numbers become missing; rows with a missing key are dropped; keys become INT."""
    numbers = [F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in [*keys, *values]]
    rest = [F.col(c) for c in df.columns if c not in (*keys, *values)]
    out = df.select(*numbers, *rest).na.drop(subset=list(keys))
    for c in keys:
        out = out.withColumn(c, F.col(c).cast("int"))
    return out


def nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The missing-data convention of this library: NaN never leaves a source."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def load_mask(layers: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """Saved mask when there is one, else every cell with a value in some layer."""
    if saved is not None:
        return saved.select("row", "col").distinct()
    return layers.where(F.col("value").isNotNull()).select("row", "col").distinct()
