"""The ledger as tables that can be written twice: inserts and updates merge into the affected buckets only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitsignal.operators.ledger import insert_once, typed, update_orders
from pitsignal.schemas import LEDGER
from pitsignal.session import cut_lineage

# fixed values: what makes a row of each table unique
NATURAL_KEYS: dict[str, tuple[str, ...]] = {
    "episodes": ("session_date", "underlying"),
    "transitions": ("transition_id",),
    "features": ("episode_id",),
    "agent_decisions": ("episode_id",),
    "risk_decisions": ("episode_id",),
    "orders": ("client_order_id",),
    "marks": ("mark_id",),
}
# which of several new rows of one key is kept: the first by these columns
FIRST_BY: dict[str, tuple[str, ...]] = {
    "episodes": ("created_at", "episode_id"),
    "transitions": ("created_at", "episode_id"),
    "features": ("created_at", "payload_json"),
    "agent_decisions": ("created_at", "payload_json"),
    "risk_decisions": ("created_at", "payload_json"),
    "orders": ("created_at", "order_id"),
    "marks": ("marked_at", "episode_id"),
}
BUCKETS = 64
_BUCKET = "bucket_no"


class LedgerStore:
    """Ledger tables below one folder, as Parquet in buckets of the natural key.

    An insert appends files of its new rows to their buckets; an update rewrites the buckets its rows fall
    into (dynamic partition overwrite of checkpointed rows), whose files become few again. Either
    leaves a marker under its commit name. A commit whose marker is there is skipped, and an insert
    never replaces a stored row, so a re-run or a repeated micro-batch leaves the same tables. One writer
    at a time; a writer that dies between two buckets is put right by running the same commit again.
    """

    def __init__(self, spark: SparkSession, path: str, *, buckets: int = BUCKETS) -> None:
        if buckets < 1:
            raise ValueError("buckets must be positive")
        self._spark, self._path, self._buckets = spark, path.rstrip("/"), buckets

    def _at(self, path: str):
        target = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self._spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        target, store = self._at(path)
        return store.exists(target)

    def _marker(self, table: str, commit: str) -> str:
        return f"{self._path}/_commits/{table}/{commit}"

    def committed(self, table: str, commit: str) -> bool:
        return self._exists(self._marker(table, commit))

    def read(self, table: str) -> DataFrame:
        """All rows of a table; none if nothing was written yet."""
        return self._bucketed(table).drop(_BUCKET)

    def _bucketed(self, table: str) -> DataFrame:
        schema = T.StructType([*LEDGER[table].fields, T.StructField(_BUCKET, T.IntegerType())])
        path = f"{self._path}/{table}"
        if not self._exists(path):
            return self._spark.createDataFrame([], schema)
        return self._spark.read.schema(schema).parquet(path)

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*NATURAL_KEYS[table]), F.lit(self._buckets)).cast("int").alias(_BUCKET)

    def _merge(self, table: str, touched: DataFrame, commit: str, combine: Callable[[DataFrame], DataFrame]) -> bool:
        """Rewrites the buckets that `touched` rows fall into with `combine` of their stored rows."""
        if self.committed(table, commit):
            return False
        hit = [r[0] for r in touched.select(self._bucket(table)).distinct().collect()]
        if hit:
            stored = self._bucketed(table).where(F.col(_BUCKET).isin(hit)).drop(_BUCKET)
            # checkpointed before the files it is read from are replaced
            merged = cut_lineage(typed(combine(stored), table).withColumn(_BUCKET, self._bucket(table)))
            writer = merged.hint("rebalance", _BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy(_BUCKET).parquet(f"{self._path}/{table}")
        self._mark(table, commit)
        return True

    def _mark(self, table: str, commit: str) -> None:
        target, store = self._at(self._marker(table, commit))
        store.create(target, True).close()

    def insert(self, table: str, rows: DataFrame, *, commit: str) -> bool:
        """Adds the rows whose natural key is not stored yet; of several new ones the first by FIRST_BY stays.

        Returns whether the commit was applied (False: it had been before).
        """
        if self.committed(table, commit):
            return False
        rows = typed(rows, table).withColumn("_order", F.struct(*FIRST_BY[table]))
        known = self.read(table).withColumn("_order", F.struct(*FIRST_BY[table]))
        fresh = typed(insert_once(known, rows, keys=NATURAL_KEYS[table], order="_order").drop("_order"), table)
        # stored rows stay as they are: only fresh ones are written, beside them
        dealt = fresh.withColumn(_BUCKET, self._bucket(table)).hint("rebalance", _BUCKET)
        dealt.write.mode("append").partitionBy(_BUCKET).parquet(f"{self._path}/{table}")
        self._mark(table, commit)
        return True

    def update_orders(self, updates: DataFrame, *, commit: str, order: str = "update_no") -> bool:
        """Applies order updates (see ledger.update_orders) to stored orders; updates of unknown orders are left out.

        `updates`: client_order_id, broker_order_id, status, payload_json, updated_at and `order`.
        """
        latest = updates.groupBy("client_order_id").agg(F.max("updated_at").alias("_at"))

        def combine(stored: DataFrame) -> DataFrame:
            # only the changed buckets are read, so an update is matched within them
            changed = update_orders(stored, updates, order=order).where("not unknown").drop("unknown")
            joined = changed.join(latest, "client_order_id", "left")
            return joined.withColumn("updated_at", F.coalesce("_at", "updated_at")).drop("_at")

        return self._merge("orders", updates, commit, combine)


def into_ledger(stream: DataFrame, store: LedgerStore, table: str, *, checkpoint: str, label: str = "stream"):
    """Starts a query that inserts every micro-batch of the stream under its batch number as commit name."""

    def write(batch: DataFrame, number: int) -> None:
        store.insert(table, batch, commit=f"{label}-{number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
