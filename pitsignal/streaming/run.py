"""Start a stream, let it take what is available, and hand back the sink as a table."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitsignal.session import scratch_path


def file_stream(spark: SparkSession, path: str, schema: T.StructType, *, max_files: int | None = None) -> DataFrame:
    """Stream over a Parquet folder, or over one file by its name within its folder."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    name = os.path.basename(path)
    found = [os.path.basename(urlparse(file).path) for file in spark.read.schema(schema).parquet(path).inputFiles()]
    if found != [name]:
        return reader.parquet(path)
    return reader.option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))


# event time of the row that tells a stream its finite source has ended, and where rows of real time stop
END_TIME, LAST_TIME = datetime(9000, 1, 1), datetime(8999, 1, 1)

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
KEYED_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def watermarked(stream: DataFrame, ts: str, delay: str) -> DataFrame:
    """`withWatermark`, and no row of the end marker beyond it.

    The filter reads the event time, so it stays above the watermark, which the marker advances.
    """
    return stream.withWatermark(ts, delay).where(F.col(ts) < F.lit(LAST_TIME).cast(stream.schema[ts].dataType))


def with_end(stream: DataFrame, ts: str) -> tuple[DataFrame, Callable[[], None]]:
    """The stream with a source of end markers, and a function that writes the marker.

    The marker is one row with END_TIME as event time. Its other columns are not null, since joins drop
    null keys below the watermark. It must come when the source is drained
    (run_available sees to that): the watermark then passes every row, and what waits in a state is
    decided. Only for finite sources: a row that comes later is late.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, "end")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in stream.schema])
    spark.createDataFrame([], schema).coalesce(1).write.parquet(path)
    marks = spark.readStream.schema(schema).parquet(path)

    def finish() -> None:
        row = tuple(END_TIME if f.name == ts else _filled(f.dataType) for f in schema)
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)

    return stream.unionByName(marks), finish


def _filled(kind: T.DataType) -> object:
    if isinstance(kind, T.StringType):
        return ""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return END_TIME
    if isinstance(kind, T.DateType):
        return END_TIME.date()
    if isinstance(kind, T.BooleanType):
        return False
    if isinstance(kind, T.IntegralType):
        return 0
    return 0.0 if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType) else None


@contextmanager
def _state_store(spark: SparkSession, keyed: bool) -> Iterator[None]:
    """The state store that keyed processors need, for a query that starts inside."""
    before = spark.conf.get(STATE_STORE, None)
    if keyed:
        spark.conf.set(STATE_STORE, KEYED_STORE)
    try:
        yield
    finally:
        if keyed:
            spark.conf.unset(STATE_STORE) if before is None else spark.conf.set(STATE_STORE, before)


def run_available(
    stream: DataFrame,
    label: str,
    *,
    timeout_seconds: int | None = None,
    partition_by: tuple[str, ...] = (),
    ends: Sequence[Callable[[], None]] = (),
    keyed: bool = False,
) -> DataFrame:
    """Drain the source into Parquet below the shared folder; state and sink survive a lost executor.

    The stream runs until the source is drained; only a caller that names a limit has one. `ends` are the
    markers of with_end: once the source is drained they are written, and the same query goes on from
    its checkpoint. `keyed` picks the state store of transformWithState.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, label)
    out = os.path.join(base, "out")
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", os.path.join(base, "state"))
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    for last in (False, True) if ends else (True,):
        with _state_store(spark, keyed):
            running = writer.trigger(availableNow=True).start()
            if timeout_seconds is None:
                running.awaitTermination()
            elif not running.awaitTermination(timeout_seconds):
                running.stop()
                raise TimeoutError(f"{label}: stream did not drain in {timeout_seconds} s")
        if not last:
            for finish in ends:
                finish()
    return spark.read.schema(stream.schema).parquet(out)
