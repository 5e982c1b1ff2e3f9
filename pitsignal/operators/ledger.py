"""Ledger tables: insert once, update, latest rows, state audit, reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitsignal.operators.ordering import range_scan, with_previous, with_sequence
from pitsignal.schemas import LEDGER, require_columns

# fixed values: legal episode transitions
TRANSITIONS: dict[str, tuple[str, ...]] = {
    "COLLECTING": ("FEATURES_FROZEN", "ABSTAINED"),
    "FEATURES_FROZEN": ("OPENING_CONFIRMATION", "ABSTAINED"),
    "OPENING_CONFIRMATION": ("CANDIDATE_READY", "ABSTAINED"),
    "CANDIDATE_READY": ("AI_REVIEWED", "ABSTAINED"),
    "AI_REVIEWED": ("RISK_APPROVED", "ABSTAINED"),
    "RISK_APPROVED": ("ORDER_SUBMITTED", "ABSTAINED"),
    "ORDER_SUBMITTED": ("ORDER_FILLED", "ORDER_CANCELLED", "ORDER_REJECTED"),
    "ORDER_FILLED": ("MONITORING",),
    "ORDER_CANCELLED": ("CLOSED",),
    "ORDER_REJECTED": ("CLOSED",),
    "MONITORING": ("EXIT_SUBMITTED",),
    "EXIT_SUBMITTED": ("CLOSED",),
    "ABSTAINED": (),
    "CLOSED": (),
}
# fixed values: broker status -> state the episode moves to
BROKER_STATES: dict[str, str] = {
    "filled": "MONITORING",
    "canceled": "CLOSED",
    "cancelled": "CLOSED",
    "expired": "CLOSED",
    "rejected": "CLOSED",
    "suspended": "CLOSED",
}


def terminal_states(transitions: Mapping[str, Sequence[str]] = TRANSITIONS) -> list[str]:
    return [state for state, targets in transitions.items() if not targets]


def typed(df: DataFrame, table: str) -> DataFrame:
    """Exactly the columns and types of a ledger table."""
    schema = LEDGER[table]
    require_columns(df, schema.fieldNames(), f"ledger table {table}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def append_table(df: DataFrame, path: str, table: str) -> None:
    typed(df, table).write.mode("append").parquet(f"{path}/{table}")


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.schema(LEDGER[table]).parquet(f"{path}/{table}")


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One count per table; each is a metadata-only scan for a columnar source."""
    counted = None
    for name, df in tables.items():
        if name not in LEDGER:
            raise ValueError(f"unsupported table: {name}")
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        counted = one if counted is None else counted.unionByName(one)
    return counted


def insert_once(existing: DataFrame, incoming: DataFrame, *, keys: Sequence[str], order: str) -> DataFrame:
    """Rows to append: the earliest incoming row of every key that is not stored yet.

    The earliest row is an aggregate, so copies of a hot key collapse before the shuffle.
    """
    keys = list(keys)
    rest = [c for c in incoming.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_first")).select(*keys, "_first.*")
    return first.join(existing.select(*keys).distinct(), keys, "left_anti").select(*incoming.columns)


def update_orders(orders: DataFrame, updates: DataFrame, *, key: str = "client_order_id", order: str = "update_no") -> DataFrame:
    """Apply updates in order: a known broker id survives a null one, status and payload are replaced.

    An update of an unknown order is kept as a row with `unknown` set instead of being lost.
    """
    seq = F.col(order)
    last = updates.groupBy(key).agg(
        F.max_by("broker_order_id", F.when(F.col("broker_order_id").isNotNull(), seq)).alias("_broker"),
        F.max_by(F.struct("status", "payload_json"), seq).alias("_new"),
    )
    joined = orders.withColumn("_known", F.lit(True)).join(last, key, "full_outer")
    changed = F.col("_new").isNotNull()
    replaced = {
        "broker_order_id": F.coalesce("_broker", "broker_order_id"),
        "status": F.when(changed, F.col("_new.status")).otherwise(F.col("status")),
        "payload_json": F.when(changed, F.col("_new.payload_json")).otherwise(F.col("payload_json")),
    }
    return joined.select(
        *[replaced[c].alias(c) if c in replaced else F.col(c) for c in orders.columns],
        F.col("_known").isNull().alias("unknown"),
    )


def latest_per(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Last row per key by a unique order column, as an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_l")).select(*keys, "_l.*").select(*df.columns)


def current_state(transitions: DataFrame) -> DataFrame:
    return transitions.groupBy("episode_id").agg(
        F.max_by("to_state", "transition_id").alias("state"), F.max("transition_id").alias("last_transition_id")
    )


def is_legal(current: Column, requested: Column, transitions: Mapping[str, Sequence[str]] = TRANSITIONS) -> Column:
    """A repeat of the current state is legal; otherwise the pair must be listed."""
    pairs = [f"{a}>{b}" for a, targets in transitions.items() for b in targets]
    return (current == requested) | F.concat(current, F.lit(">"), requested).isin(pairs)


def replay_steps(
    requests: DataFrame, *, allowed: Mapping[str, Sequence[str]] = TRANSITIONS, initial: str = "COLLECTING", width: int = 1024
) -> DataFrame:
    """What the episode machine does with recorded requests, in id order: applied, repeat or illegal.

    Expects episode_id, transition_id (unique integer), requested. The batch form of
    `streaming.episodes.episode_steps`. A request is a map from each known state to the next; the maps of
    a range of ids compose to one, so an episode of any length is spread over its ranges. A request for
    an unknown state is illegal.
    """
    names = list(dict.fromkeys([initial, *allowed, *(t for targets in allowed.values() for t in targets)]))
    entry = [
        F.when(F.col("requested").isin([t for t in allowed.get(state, ()) if t != state]), F.array_position(F.lit(names), F.col("requested")).cast("int") - 1).otherwise(i)
        for i, state in enumerate(names)
    ]
    compose = lambda older, newer: F.transform(older, lambda state: F.get(newer, state))
    stepped = range_scan(requests, ["episode_id"], "transition_id", F.array(*entry), compose, "_past", width=width)
    source = F.coalesce(F.get(F.lit(names), F.get("_past", F.lit(0))), F.lit(initial))
    known = stepped.withColumn("from_state", source)
    pairs = [f"{a}>{b}" for a, targets in allowed.items() for b in targets]
    outcome = (
        F.when(F.col("requested") == F.col("from_state"), "repeat")
        .when(F.concat("from_state", F.lit(">"), "requested").isin(pairs), "applied")
        .otherwise("illegal")
    )
    return known.select("episode_id", "transition_id", "from_state", F.col("requested").alias("to_state"), outcome.alias("outcome"))


def audit_paths(transitions: DataFrame, allowed: Mapping[str, Sequence[str]] = TRANSITIONS) -> DataFrame:
    """Flag illegal steps, gaps in the chain and steps out of a terminal state."""
    stepped = with_previous(transitions, ["episode_id"], "transition_id", "to_state", "_before")
    before = F.col("_before")
    source = F.col("from_state")
    return stepped.select(
        "episode_id",
        "transition_id",
        "from_state",
        "to_state",
        (source.isNotNull() & ~is_legal(source, F.col("to_state"), allowed)).alias("illegal_step"),
        F.coalesce(before != source, F.lit(False)).alias("broken_chain"),
        F.coalesce(before.isin(terminal_states(allowed)), F.lit(False)).alias("left_terminal"),
    )


def reconcile(orders: DataFrame, broker: DataFrame, *, key: str) -> DataFrame:
    """Local orders against broker statuses; a missing broker row makes the order indeterminate."""
    remote = broker.select(key, F.lower("broker_status").alias("_status"))
    status = F.coalesce("_status", F.lit("indeterminate"))
    mapping = F.create_map(*[F.lit(x) for pair in BROKER_STATES.items() for x in pair])
    return orders.join(remote, key, "left").select(
        *orders.columns,
        status.alias("reconciled_status"),
        F.coalesce(mapping[status], F.lit("ORDER_SUBMITTED")).alias("next_state"),
        F.col("_status").isNotNull().alias("reconciled"),
    )


def with_latest_reason(episodes: DataFrame, transitions: DataFrame, state: str = "ABSTAINED") -> DataFrame:
    """Episodes with the reason of their last transition into `state` (null when none or unreadable)."""
    into = transitions.where(F.col("to_state") == state)
    last = into.groupBy("episode_id").agg(F.max_by("payload_json", "transition_id").alias("_payload"))
    return episodes.join(last, "episode_id", "left").select(
        *episodes.columns, F.get_json_object("_payload", "$.reason").alias("reason")
    )


def unresolved(episodes: DataFrame, terminal: Sequence[str]) -> DataFrame:
    return episodes.where(~F.col("state").isin(list(terminal)))


def oldest_unresolved(episodes: DataFrame, terminal: Sequence[str]) -> DataFrame:
    """Earliest (session, creation) open episode of every underlying."""
    rest = [c for c in episodes.columns if c != "underlying"]
    rank = F.struct("session_date", "created_at", "episode_id")
    open_rows = unresolved(episodes, terminal)
    return open_rows.groupBy("underlying").agg(F.min_by(F.struct(*rest), rank).alias("_o")).select("underlying", "_o.*").select(*episodes.columns)


def startable_sessions(requests: DataFrame, episodes: DataFrame, terminal: Sequence[str]) -> DataFrame:
    """Session requests with no unresolved earlier episode of their underlying.

    Only the earliest open session per underlying matters, so the blocking side is one row each.
    """
    blocking = unresolved(episodes, terminal).groupBy("underlying").agg(F.min("session_date").alias("_open_since"))
    joined = requests.join(blocking, "underlying", "left")
    return joined.where(F.col("_open_since").isNull() | (F.col("_open_since") >= F.col("session_date"))).select(*requests.columns)


def latest_episodes(episodes: DataFrame, limit: int) -> DataFrame:
    """Newest first; the limit is the feature and runs as a per-task top-k."""
    if not 0 < limit <= 1000:
        raise ValueError("limit must be between 1 and 1000")
    return episodes.orderBy(F.desc("session_date"), F.desc("created_at"), F.desc("episode_id")).limit(limit)


def orders_in_sequence(orders: DataFrame) -> DataFrame:
    """Orders with their number inside the episode, in id order."""
    return with_sequence(orders, ["episode_id"], "order_id", "sequence_no")
