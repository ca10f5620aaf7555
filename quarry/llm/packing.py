"""Packing texts, measured in tokens, into containers of fixed capacity (problem 7)."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quarry.llm.tokens import packed_ids, vocabulary_path

CAPACITY = 2048
#: Pieces packed together. It bounds a task's memory, and leaves at most a few open containers in some thousands.
BLOCK = 32_768
#: Cost of a piece of n tokens: n + n * n / LINEAR_UNTIL, so that attention outweighs the rest from that length on.
LINEAR_UNTIL = 4096


def cost(n: int) -> float:
    return n + n * n / LINEAR_UNTIL


class _Open:
    """The open containers by free room, with the cheapest of all that have at least some room found in log time."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.width)]
        self.best: list[tuple[float, int]] = [(float("inf"), -1)] * (2 * self.width)

    def _refresh(self, room: int) -> None:
        best, at = self.best, room + self.width
        best[at] = self.heaps[room][0] if self.heaps[room] else (float("inf"), -1)
        at >>= 1
        while at:
            new = min(best[2 * at], best[2 * at + 1])
            if best[at] == new:
                break
            best[at] = new
            at >>= 1

    def add(self, room: int, cost_so_far: float, container: int) -> None:
        heappush(self.heaps[room], (cost_so_far, container))
        self._refresh(room)

    def take(self, size: int) -> tuple[int, float, int] | None:
        """Removes the cheapest container with room for ``size``: its room, cost and number."""
        low, high, found = size + self.width, 2 * self.width, []
        while low < high:
            if low & 1:
                found.append(low)
                low += 1
            if high & 1:
                high -= 1
                found.append(high)
            low >>= 1
            high >>= 1
        at = min(found, key=lambda x: self.best[x])
        if self.best[at][1] < 0:
            return None
        want = self.best[at]
        while at < self.width:
            at = 2 * at if self.best[2 * at] == want else 2 * at + 1
        room = at - self.width
        heappop(self.heaps[room])
        self._refresh(room)
        return room, *want


def pack_block(sizes: list[int], capacity: int = CAPACITY) -> tuple[list[int], int]:
    """The container of each size (none above ``capacity``), and how many there are.

    As many containers as the total needs at least are opened first. Sizes go in descending order (ties in the given
    order) to the container of lowest cost that has room; where none has, a new one is opened. Size 0 costs nothing.
    """
    free = _Open(capacity)
    count = -(-sum(sizes) // capacity)
    for container in range(count):
        free.add(capacity, 0.0, container)
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda x: -sizes[x]):
        size = sizes[i]
        room, so_far, container = free.take(size) or (capacity, 0.0, count)
        count = max(count, container + 1)
        out[i] = container
        free.add(room - size, so_far + cost(size), container)
    return out, count


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None, block: int = BLOCK) -> DataFrame:
    """``key, piece, n_pieces, first_token, n_tokens, container_id``: where the tokens of each text go.

    A text over the capacity is cut into full pieces and a rest; all others stay whole (one piece, number 0). Empty and
    null texts are one piece of 0 tokens in some container. Repeated rows are packed as often as they occur. Containers
    are made within blocks of ``block`` texts of one task, so nothing is shuffled and no group is gathered; an id is the
    task's number and a running number in it, and stays the same when the task is run again.
    """
    path = path or vocabulary_path()
    kind = df.schema[key].dataType

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 33
        keys: list[pa.Array] = []
        totals: list[int] = []

        def flush() -> pa.RecordBatch:
            nonlocal base
            sizes = np.array(totals, np.int64)
            pieces = np.maximum(1, -(-sizes // capacity))
            row = np.repeat(np.arange(len(sizes)), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            part = np.minimum(capacity, sizes[row] - piece * capacity)
            containers, count = pack_block(part.tolist(), capacity)
            out = [
                pa.chunked_array(keys).combine_chunks().take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(pieces[row].astype(np.int32)),
                pa.array(piece * capacity), pa.array(part), pa.array(np.array(containers, np.int64) + base),
            ]
            base += max(count, 1)
            keys.clear()
            totals.clear()
            return pa.RecordBatch.from_arrays(out, ["_key", "piece", "n_pieces", "first_token", "n_tokens", "container_id"])

        for batch in batches:
            sizes = [len(x) // 4 for x in packed_ids(batch, "_text", path)]
            for start in range(0, len(sizes), block):
                part = sizes[start : start + block]
                if len(totals) + len(part) > block:
                    yield flush()
                keys.append(batch.column("_key").slice(start, len(part)))
                totals.extend(part)
        if totals:
            yield flush()

    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    out = rows.mapInArrow(pack, f"_key {kind.simpleString()}, piece int, n_pieces int, first_token long, n_tokens long, container_id long")
    return out.withColumnRenamed("_key", key)


def split_documents(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """The keys of the texts that did not fit into one container."""
    return packed.filter(F.col("n_pieces") > 1).select(key).distinct()


def container_fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens in them, their share of the capacity, and the spread of the containers' costs."""
    square = (F.col("n_tokens") * F.col("n_tokens")).cast("double")
    each = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("n_tokens") + square / LINEAR_UNTIL).alias("cost"))
    return each.agg(
        F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / (F.count("*") * F.lit(capacity))).alias("fill"),
        F.avg("cost").alias("mean_cost"), F.stddev_pop("cost").alias("cost_spread"),
    )
