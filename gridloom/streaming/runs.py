"""File-source streams and their bounded runs."""
from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from gridloom.sources.sinks import staging

#: Event time of end rows, beyond every window of real data.
END = datetime(9000, 1, 1)


def table_stream(spark: SparkSession, folder: str, table: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream one table of a folder; new files of the table become new micro-batches.

    Event times need an instant, so zone-less timestamps are read in the session time zone
    (UTC by default, see :mod:`gridloom.session`).
    """
    reader = spark.readStream.schema(spark.read.parquet(f"{folder}/{table}.parquet").schema).option("pathGlobFilter", f"{table}*.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream = reader.parquet(folder)
    local = [f.name for f in stream.schema if f.dataType.simpleString() == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in local})


def folder_stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None, nested: bool = False) -> DataFrame:
    """Stream the Parquet files another query appends to a folder, or to folders in it."""
    reader = spark.readStream.schema(schema)
    if nested:
        reader = reader.option("recursiveFileLookup", "true")
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def drain(stream: DataFrame, label: str) -> tuple[DataFrame, dict]:
    """Process everything available into Parquet and return (rows, summed progress counters)."""
    path, counters = drain_to_folder(stream, label)
    return stream.sparkSession.read.schema(stream.schema).parquet(path), counters


def drain_windows_to_folder(source: DataFrame, time: str, build: Callable[[DataFrame], DataFrame], label: str, ends: Sequence[dict] = ({},), feeds: Sequence[Callable[[], None]] = (lambda: None,)) -> tuple[str, dict]:
    """Process everything available of ``source`` through the windowed query ``build``, the last windows too.

    A bounded run leaves the windows open that its watermark has not passed. When all rows are in, a second run from
    the same state reads end rows, whose time lies beyond every window, and so closes them; windows of the end rows
    stay open. ``ends`` gives column values of the end rows: one for each branch of a query that filters its source,
    with the keys of a join (a row without them never reaches the watermark). ``feeds`` are steps that add files to
    the source: each is followed by a run of its own from the same state, so its files are one micro-batch.
    """
    spark = source.sparkSession
    folder, out, state = (staging(spark, f"{label}{part}") for part in ("_end", "", "_state"))
    spark.createDataFrame([], source.schema).write.parquet(folder)

    def query() -> DataFrame:
        return build(source.unionByName(folder_stream(spark, folder, source.schema)))

    counters: dict[str, int] = {}
    for feed in feeds:
        feed()
        for name, n in drain_to_folder(query(), label, (out, state))[1].items():
            counters[name] = counters.get(name, 0) + n
    nullable = StructType([StructField(f.name, f.dataType) for f in source.schema])
    rows = [tuple(END if f.name == time else end.get(f.name) for f in source.schema) for end in ends]
    spark.createDataFrame(rows, nullable).write.mode("append").parquet(folder)
    drain_to_folder(query(), label, (out, state))
    return out, counters


def drain_windows(source: DataFrame, time: str, build: Callable[[DataFrame], DataFrame], label: str, ends: Sequence[dict] = ({},), feeds: Sequence[Callable[[], None]] = (lambda: None,)) -> tuple[DataFrame, dict]:
    """Rows of :func:`drain_windows_to_folder` and the counters of the run over ``source``."""
    path, counters = drain_windows_to_folder(source, time, build, label, ends, feeds)
    return source.sparkSession.read.schema(build(source).schema).parquet(path), counters


def drain_to_folder(stream: DataFrame, label: str, folders: tuple[str, str] | None = None) -> tuple[str, dict]:
    """Process everything available into a Parquet folder that another stream may read; ``folders`` (output, state)
    go on from an earlier run of the same query."""
    spark = stream.sparkSession
    out, state = folders or (staging(spark, label), staging(spark, f"{label}_state"))
    # every micro-batch's progress counts, not only the last hundred's
    keep = "spark.sql.streaming.numRecentProgressUpdates"
    before = spark.conf.get(keep)
    spark.conf.set(keep, str(10**6))
    run = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        .outputMode("append").trigger(availableNow=True).start()
    )
    spark.conf.set(keep, before)
    run.awaitTermination()
    counters: dict[str, int] = {"late_rows": 0, "input_rows": 0}
    for progress in run.recentProgress:
        counters["input_rows"] += progress.numInputRows
        for op in progress.stateOperators:
            counters["late_rows"] += op.numRowsDroppedByWatermark
        for name, row in (progress.observedMetrics or {}).items():
            for key, value in row.asDict().items():
                if isinstance(value, (int, float)):
                    counters[f"{name}.{key}"] = counters.get(f"{name}.{key}", 0) + value
    return out, counters
