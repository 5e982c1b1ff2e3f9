"""Best-fit packing of evidence into model contexts, improved by swaps between underfull bins."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitsignal.llm.tokens import encoder
from pitsignal.session import cut_lineage

CAPACITY = 2048
END_ID = 0
GROUP = 60_000  # pieces packed together by one task
SPAN = 1 << 32  # sequence numbers of a group


def pieces(evidence: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """item_id, piece, start, length, ids_crc32: the token ids of each item, cut where longer than a context."""
    kind = dict(evidence.dtypes)["item_id"]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(vocabulary, spaces_count=False).encode
        end = np.uint16(end_id).tobytes()
        for batch in batches:
            rows = []
            for item, ids in zip(batch["item_id"], encode(batch["content"].tolist())):
                wide = np.frombuffer(ids + end, dtype="<u2").astype("<u4")
                for number, start in enumerate(range(0, len(wide), capacity)):
                    part = wide[start : start + capacity]
                    rows.append((item, number, start, len(part), zlib.crc32(part.tobytes())))
            yield pd.DataFrame(rows, columns=["item_id", "piece", "start", "length", "ids_crc32"])

    return evidence.select("item_id", "content").mapInPandas(
        cut, f"item_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of piece indexes: longest piece first, into the open bin it fills best."""
    bins: list[list[int]] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # bit r is set if a bin with room r is open
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
            bins[at].append(i)
        else:
            room, at = capacity, len(bins)
            bins.append([i])
        left = room - n
        if left:
            open_bins[left].append(at)
            rooms |= 1 << left
    return bins


class _Underfull:
    """Underfull bins by room: which have a piece of a size, and which have two pieces of a sum, as bit masks."""

    def __init__(self, size: list[int], bins: list[list[int]], fill: list[int], capacity: int):
        self.size, self.bins, self.fill, self.capacity = size, bins, fill, capacity
        self.rooms = 0  # bit r is set if a bin has room r
        self.at: dict[int, set[int]] = {}
        self.masks: dict[int, list[int]] = {}  # by room: sizes, sums
        self.found: dict[tuple[int, int, int], set[int]] = {}  # (room, 0 or 1, size or sum) to bins

    def _keys(self, k: int) -> tuple[set[int], set[int]]:
        counts = Counter(self.size[i] for i in self.bins[k])
        sizes = sorted(counts)
        sums = {x + y for a, x in enumerate(sizes) for y in sizes[a + 1 :]} | {2 * x for x in sizes if counts[x] > 1}
        return set(sizes), sums

    def add(self, k: int) -> None:
        room = self.capacity - self.fill[k]
        if not room or not self.bins[k]:
            return
        self.rooms |= 1 << room
        self.at.setdefault(room, set()).add(k)
        masks = self.masks.setdefault(room, [0, 0])
        for kind, keys in enumerate(self._keys(k)):
            for x in keys:
                self.found.setdefault((room, kind, x), set()).add(k)
                masks[kind] |= 1 << x

    def remove(self, k: int) -> None:
        room = self.capacity - self.fill[k]
        self.at[room].remove(k)
        masks = self.masks[room]
        for kind, keys in enumerate(self._keys(k)):
            for x in keys:
                held = self.found[room, kind, x]
                held.remove(k)
                if not held:
                    del self.found[room, kind, x]
                    masks[kind] ^= 1 << x
        if not self.at[room]:
            del self.at[room], self.masks[room]
            self.rooms ^= 1 << room

    def best(self, giver: int) -> tuple[int, int, list[int], int] | None:
        """Piece of the giver, taker, pieces to give back, and gain, of the step that fills a fuller bin most."""
        by_size = {self.size[i]: i for i in self.bins[giver]}
        gain, step = 0, None
        rooms = self.rooms & ((2 << (self.capacity - self.fill[giver])) - 1)
        while rooms:
            room = rooms.bit_length() - 1
            if room <= gain:
                break
            rooms ^= 1 << room
            masks = self.masks[room]
            for s in by_size:
                if s <= gain:
                    continue
                if s <= room:
                    gain, step = s, (s, room, -1, 0)
                    continue
                for kind in (0, 1):
                    above = masks[kind] >> (s - room)
                    if above:
                        x = s - room + (above & -above).bit_length() - 1
                        if s - x > gain:
                            gain, step = s - x, (s, room, kind, x)
        if step is None:
            return None
        s, room, kind, x = step
        taker = next(iter(self.at[room] if kind < 0 else self.found[room, kind, x]))
        own = self.bins[taker]
        back: list[int] = []
        if kind == 0:
            back = [next(i for i in own if self.size[i] == x)]
        elif kind == 1:
            seen: dict[int, int] = {}
            for i in own:
                if x - self.size[i] in seen:
                    back = [seen[x - self.size[i]], i]
                    break
                seen[self.size[i]] = i
        return by_size[s], taker, back, gain


def swap_search(lengths: np.ndarray, bins: list[list[int]], capacity: int) -> list[list[int]]:
    """Bins after moves and exchanges between underfull bins that increase the sum of squared fills.

    From the emptiest underfull bin on, a bin takes the step that fills another, fuller one most, as
    long as there is one: moving one of its pieces over, or exchanging one of its pieces for one or
    two smaller ones. Any step that makes the fuller bin fuller increases the squared fill, as the
    total stays the same, so the search is finite. It ends when no bin has a step left, or when the
    bins reach the bound ceil(total / capacity). A step is a lookup by room, size and sum of two sizes.
    """
    size = lengths.tolist()
    bins = [list(b) for b in bins]
    fill = [sum(size[i] for i in b) for b in bins]
    bound = -(-sum(fill) // capacity)
    live = sum(1 for b in bins if b)
    if live <= bound:
        return [b for b in bins if b]
    index = _Underfull(size, bins, fill, capacity)
    for k in range(len(bins)):
        index.add(k)
    stepped = True
    while stepped and live > bound:
        stepped = False
        for giver in sorted((k for k in range(len(bins)) if bins[k] and fill[k] < capacity), key=lambda k: fill[k]):
            if fill[giver] == capacity:  # filled meanwhile
                continue
            index.remove(giver)
            while bins[giver] and (step := index.best(giver)):
                give, taker, back, gain = step
                index.remove(taker)
                bins[giver] = [i for i in bins[giver] if i != give] + back
                bins[taker] = [i for i in bins[taker] if i not in back] + [give]
                fill[giver] -= gain
                fill[taker] += gain
                index.add(taker)
                stepped = True
            index.add(giver)
            live -= not bins[giver]
            if live <= bound:
                break
    return [b for b in bins if b]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    return swap_search(lengths, best_fit(lengths, capacity), capacity)


def pack_evidence(evidence: DataFrame, vocabulary: str, *, capacity: int = CAPACITY, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """Places of evidence items in as few contexts (sequences of at most `capacity` tokens) as possible.

    Expects item_id and content; `vocabulary` is the file of a public tokenizer. An item is its
    token ids and `end_id`; only an item longer than a context is cut. Returns per piece: item_id,
    piece, start (ids of the item before it), length, ids_crc32, sequence_id, offset (place in the
    sequence, gapless from 0).

    Null content is empty (the end id alone). Repeated rows are packed each. An empty table gives an
    empty result. Other columns are ignored. Pieces are dealt at random into groups of about `group`
    and packed per group, which costs at most about one part-filled sequence a group; full pieces
    are sequences of their own. Only lengths and checksums are shuffled, never texts or ids.
    """
    cut = cut_lineage(pieces(evidence, vocabulary, capacity, end_id))
    groups = max(1, -(-cut.where(F.col("length") < capacity).count() // group))
    key = F.pmod(F.xxhash64("item_id", "piece", "ids_crc32", "length"), F.lit(groups)).cast("long")
    # full pieces need no company and stay out of the groups
    spread = cut.withColumn("bin_group", F.when(F.col("length") < capacity, key).otherwise(F.lit(-1).cast("long")))
    kind = dict(cut.dtypes)["item_id"]
    schema = f"item_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(["length", "item_id", "piece"], kind="stable").reset_index(drop=True)
        lengths = batch["length"].to_numpy()
        number, offset = np.zeros(len(batch), dtype=np.int64), np.zeros(len(batch), dtype=np.int64)
        for at, members in enumerate(pack(lengths, capacity)):
            number[members] = at
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        # even numbers are packed sequences, odd ones full pieces
        batch["sequence_id"] = 2 * (batch["bin_group"] * SPAN + number)
        batch["offset"] = offset
        return batch.drop(columns="bin_group")

    packed = spread.where(F.col("bin_group") >= 0).groupBy("bin_group").applyInPandas(place, schema)
    full = spread.where(F.col("bin_group") < 0).drop("bin_group")
    alone = full.withColumn("sequence_id", 2 * F.monotonically_increasing_id() + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone.select(packed.columns))

