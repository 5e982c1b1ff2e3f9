"""Minimum-cost-flow resharding: the fewest bytes move from an old layout to new capacities."""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitsignal.session import cut_lineage

BLOCK_BYTES = 8 << 20


def min_cost_flow(supply: Sequence[int], capacity: Sequence[int], cost: Mapping[tuple[int, int], int]) -> dict[tuple[int, int], int]:
    """Cheapest flow of all supplies into the capacities, by successive shortest paths with potentials.

    `cost` is per byte from source i to sink j. The network has one node per shard, so its size does
    not depend on the data. Raises if the capacities do not hold the supplies.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities do not hold the supplies")
    m, n = len(supply), len(capacity)
    source, sink = m + n, m + n + 1
    graph: list[list[list[int]]] = [[] for _ in range(m + n + 2)]  # [to, room, cost, index of the reverse edge]

    def edge(a: int, b: int, room: int, price: int) -> None:
        graph[a].append([b, room, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, size in enumerate(supply):
        edge(source, i, size, 0)
        for j in range(n):
            edge(i, m + j, size, cost[i, j])
    for j, size in enumerate(capacity):
        edge(m + j, sink, size, 0)
    potential = [0] * len(graph)
    left = sum(supply)
    while left:
        dist: list[float] = [float("inf")] * len(graph)
        via: list[tuple[int, int] | None] = [None] * len(graph)
        dist[source] = 0
        heap = [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for k, (b, room, price, _) in enumerate(graph[a]):
                far = d + price + potential[a] - potential[b]
                if room and far < dist[b]:
                    dist[b], via[b] = far, (a, k)
                    heapq.heappush(heap, (far, b))
        potential = [p + (int(d) if d < float("inf") else 0) for p, d in zip(potential, dist)]
        path, at = [], sink
        while at != source:
            a, k = via[at]
            path.append(graph[a][k])
            at = a
        push = min(left, *(e[1] for e in path))
        for e in path:
            e[1] -= push
            graph[e[0]][e[3]][1] += push
        left -= push
    return {(i, e[0] - m): size - e[1] for i, size in enumerate(supply) for e in graph[i] if m <= e[0] < m + n and size > e[1]}


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def content_size(content: Column) -> Column:
    """Bytes of the UTF-8 text and one more for its end; one for null."""
    return (F.coalesce(F.octet_length(content), F.lit(0)) + 1).cast("long")


def block_transfers(sizes: Mapping[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """(old shard, new shard, from, upto): stretches of the old shards' bytes and where they go.

    What stays comes first in an old shard. Capacities are equal to a byte; a byte that stays in a
    shard of the same number is free, any other costs one.
    """
    old = sorted(sizes)
    supply = [sizes[i] for i in old]
    cost = {(a, j): int(i != j) for a, i in enumerate(old) for j in range(shards)}
    flow = min_cost_flow(supply, even_capacities(sum(supply), shards), cost)
    out = []
    for a, i in enumerate(old):
        begin = 0
        for j in sorted((j for x, j in flow if x == a), key=lambda j: (j != i, j)):
            out.append((i, j, begin, begin + flow[a, j]))
            begin += flow[a, j]
    return out


def plan_shards(evidence: DataFrame, shards: int, *, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All evidence columns with size, new_shard, slot (gapless from 0 in the new shard) and moved.

    Expects item_id, content and shard (the integer number of the old shard; null counts as shard 0).
    The transfers come from the shards' byte totals alone; each item goes where its middle byte goes,
    so a shard's size is off by at most half an item at each cut. Items of a shard are ordered by a
    hash in blocks of about `block_bytes`; positions are sums within a block plus block offsets, so
    no task holds a shard, and a shard with a third of all rows is as many tasks as it has blocks.

    Null content has size 1. Rows of equal ids (and repeated rows) each get a slot. An empty table
    gives an empty result. Input columns named size, new_shard, slot or moved are replaced.
    """
    old = F.coalesce(F.col("shard"), F.lit(0)).cast("int")
    sized = evidence.drop("size", "new_shard", "slot", "moved").withColumns({"_old": old, "size": content_size(F.col("content"))})
    # one row per old shard
    sizes = {r["_old"]: r["bytes"] for r in sized.groupBy("_old").agg(F.sum("size").alias("bytes")).collect()}
    blocks = max(1, -(-sum(sizes.values()) // block_bytes))
    sized = sized.withColumn("_block", F.pmod(F.xxhash64("item_id", "size"), F.lit(blocks)))
    inside = Window.partitionBy("_old", "_block").orderBy(F.xxhash64("item_id"), "item_id", "size")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("_old").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = sized.groupBy("_old", "_block").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    offsets = cut_lineage(
        totals.select(
            F.col("_old").alias("_of_old"),
            F.col("_block").alias("_of_block"),
            F.coalesce(F.sum("_bytes").over(earlier), F.lit(0)).alias("_bytes_before"),
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        )
    )
    # at most (old shards + new shards) rows
    stretches = block_transfers(sizes, shards)

    def target(frame: DataFrame) -> DataFrame:
        placed = frame.withColumns({"_end": F.sum("size").over(upto), "_row": F.row_number().over(inside)})
        match = (placed["_old"] == offsets["_of_old"]) & (placed["_block"] == offsets["_of_block"])
        at = placed.join(offsets, match).withColumn("_middle", F.col("_bytes_before") + F.col("_end") - F.ceil(F.col("size") / 2))
        new = F.lit(None).cast("int")
        for i, j, begin, end in stretches:
            new = F.when((F.col("_old") == i) & (F.col("_middle") >= begin) & (F.col("_middle") < end), j).otherwise(new)
        return at.withColumn("new_shard", new)

    # rows per (old, new) pair: where a stretch begins in its old shard and in its new one
    counted = target(sized.select("item_id", "size", "_old", "_block")).groupBy("_old", "new_shard").agg(F.count(F.lit(1)).alias("n"))
    counts = {(r["_old"], r["new_shard"]): r["n"] for r in counted.collect()}
    shift, of_old, of_new = F.lit(None).cast("long"), {}, {}
    for i, j, _, _ in stretches:
        n = counts.get((i, j), 0)
        base = of_new.get(j, 0) - of_old.get(i, 0)
        shift = F.when((F.col("_old") == i) & (F.col("new_shard") == j), F.lit(base)).otherwise(shift)
        of_old[i], of_new[j] = of_old.get(i, 0) + n, of_new.get(j, 0) + n
    kept = [c for c in evidence.columns if c not in ("size", "new_shard", "slot", "moved")]
    return target(sized).select(
        *kept,
        "size",
        "new_shard",
        (F.col("_rows_before") + F.col("_row") - 1 + shift).cast("long").alias("slot"),
        (F.col("new_shard") != F.col("_old")).alias("moved"),
    )


def rewrite_shards(planned: DataFrame, path: str) -> tuple[list[int], list[int]]:
    """Write the shards that lose or gain an item to `path`/shard=<number>, one folder a shard.

    Tasks write the blocks they hold; a shard is therefore several files and no task writes it whole.
    A shard whose items all stay is not written: its old files remain valid. Returns the numbers of
    the written shards and those of the others that hold items.
    """
    old = F.coalesce(F.col("shard"), F.lit(0)).cast("int").alias("old")
    # one row per pair of shards
    ways = {(r["old"], r["new_shard"]) for r in planned.select(old, "new_shard").distinct().collect()}
    affected = sorted({s for way in ways if way[0] != way[1] for s in way})
    rows = _as_written(planned.where(F.col("new_shard").isin(affected)))
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return affected, sorted({new for _, new in ways} - set(affected))


def read_shards(planned: DataFrame, path: str, unaffected: Sequence[int]) -> DataFrame:
    """All items in their new shards: written ones from `path`, the `unaffected`, whose files are the old ones, from the plan."""
    others = _as_written(planned.where(F.col("new_shard").isin(list(unaffected))))
    # without a schema a folder without files, as of an empty table, cannot be read
    written = planned.sparkSession.read.schema(others.schema).parquet(path).select(*others.columns)
    return written.unionByName(others) if unaffected else written


def _as_written(planned: DataFrame) -> DataFrame:
    return planned.drop("shard", "moved").withColumnRenamed("new_shard", "shard")
