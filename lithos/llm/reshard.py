"""Resharding by minimum-cost flow.

Blocks are the documents of one old shard and one size class. The flow sends
rows of blocks to new shards; keeping a row costs nothing, moving it costs its
block's mean bytes; every new shard takes a floor of rows and as few as possible
take one more. The graph has one node for each block and shard, so it does not
grow with the corpus. The flow cuts each block into runs of ranks, and the runs
give every row its shard and slot; no text is shuffled. Ranks go from the largest
rows of a block, which stay, to the smallest, which move, in steps of a
``STEPS``-th of the class. Rewriting touches only the files of shards that rows
leave or enter.

The law is ``rows``: shard counts differ by one at most. Equal texts are not
kept together: a group of copies may be larger than a shard.

Defined results. A null text has no bytes and the checksum of the empty text.
Repeated rows are placed one by one. A null id is a value like any other, also
when files are rewritten. An empty table gives no rows. Extra columns are ignored
by the placement and kept by the rewriting.
"""

from __future__ import annotations

import heapq
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lithos.llm._common import ranked
from lithos.sources import storage

SHARDS = 24
#: Steps by size within a size class.
STEPS = 64


class Run(NamedTuple):
    """Ranks ``first <= rank < last`` of a block go to ``shard`` from ``slot``."""

    block: int
    first: int
    last: int
    shard: int
    slot: int


class _Flow:
    """Minimum-cost flow by successive shortest paths with potentials."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def used(self, arc: int) -> int:
        return self.room[arc ^ 1]

    def run(self, source: int, sink: int, amount: int) -> None:
        n = len(self.out)
        height = [0] * n
        while amount > 0:
            far, via = [None] * n, [-1] * n
            far[source], heap = 0, [(0, source)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    y = self.to[e]
                    if self.room[e] > 0:
                        v = d + self.cost[e] + height[x] - height[y]
                        if far[y] is None or v < far[y]:
                            far[y], via[y] = v, e
                            heapq.heappush(heap, (v, y))
            if far[sink] is None:
                raise ValueError("capacities are smaller than the rows")
            for x in range(n):
                height[x] += far[x] if far[x] is not None else far[sink]
            step, x = amount, sink
            while x != source:
                step, x = min(step, self.room[via[x]]), self.to[via[x] ^ 1]
            x = sink
            while x != source:
                self.room[via[x]] -= step
                self.room[via[x] ^ 1] += step
                x = self.to[via[x] ^ 1]
            amount -= step


def transfers(blocks: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int]]:
    """``(block, shard, rows)`` of least moved bytes, from ``(old shard, rows,
    bytes)`` of every block."""
    total = sum(rows for _, rows, _ in blocks)
    floor = total // shards
    n = len(blocks)
    hub, source, sink = n + shards, n + shards + 1, n + shards + 2
    flow = _Flow(n + shards + 3)
    extra = 1 + max((b // max(rows, 1) + 1 for _, rows, b in blocks), default=0) * 4
    own, away = {}, {}
    for k, (old, rows, size) in enumerate(blocks):
        flow.arc(source, k, rows, 0)
        if old < shards:
            own[k] = flow.arc(k, n + old, rows, 0)
        away[k] = flow.arc(k, hub, rows, max(1, size // max(rows, 1)))
    into = [flow.arc(hub, n + j, total, 0) for j in range(shards)]
    for j in range(shards):
        flow.arc(n + j, sink, floor, 0)
        flow.arc(n + j, sink, 1, extra)
    flow.run(source, sink, total)
    out = [(k, blocks[k][0], flow.used(e)) for k, e in own.items() if flow.used(e)]
    wanted = [[j, flow.used(into[j])] for j in range(shards) if flow.used(into[j])]
    for k, e in away.items():
        left = flow.used(e)
        while left:
            step = min(left, wanted[-1][1])
            out.append((k, wanted[-1][0], step))
            left -= step
            wanted[-1][1] -= step
            if not wanted[-1][1]:
                wanted.pop()
    return out


def runs(blocks: list[tuple[int, int, int]], shards: int) -> list[Run]:
    """The transfers as runs of ranks and slots; what stays comes first."""
    at, slot, out = [0] * len(blocks), [0] * shards, []
    for k, j, rows in sorted(transfers(blocks, shards), key=lambda t: (t[0], t[1] != blocks[t[0]][0], t[1])):
        out.append(Run(k, at[k], at[k] + rows, j, slot[j]))
        at[k] += rows
        slot[j] += rows
    return out


def _sized(docs: DataFrame, old_shard: Column, text_col: str, **keep: Column) -> DataFrame:
    """Kept columns, size, checksum, old shard, block, and the step of the size
    within its class, from the largest."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        *[c.alias(k) for k, c in keep.items()], (F.octet_length(text) + 8).cast("long").alias("_size"), F.crc32(text.cast("binary")).alias("_crc"), old_shard.cast("int").alias("_old")
    )
    bits = F.length(F.bin("_size"))
    step = F.floor((F.col("_size") / F.pow(F.lit(2.0), bits - 1) - 1) * STEPS)
    return rows.withColumns({"_block": F.col("_old") * 64 + bits, "_step": (F.lit(STEPS - 1) - step).cast("int")})


def _plan(rows: DataFrame, shards: int) -> tuple[list[tuple], int]:
    """Runs as rows ``_b, _first, _last, shard, _slot``, and the number of rows.
    Old shards times size classes reach the driver, at any corpus size."""
    found = sorted(rows.groupBy("_block").agg(F.count(F.lit(1)), F.sum("_size")).collect())
    plan = runs([(b // 64, n, s) for b, n, s in found], shards)
    return [(found[r.block][0], r.first, r.last, r.shard, r.slot) for r in plan], sum(n for _, n, _ in found)


def _assigned(rows: DataFrame, plan: list[tuple], total: int, order: list[str]) -> DataFrame:
    """``rows`` with ``shard`` and ``_slot``."""
    table = rows.sparkSession.createDataFrame(plan, "_b int, _first bigint, _last bigint, shard int, _start bigint")
    placed = ranked(rows, "_block", order, total=total, first="_step")
    # A row for each transfer: at most blocks + shards of them.
    placed = placed.join(F.broadcast(table), (F.col("_block") == F.col("_b")) & (F.col("rank") >= F.col("_first")) & (F.col("rank") < F.col("_last")))
    return placed.withColumn("_slot", F.col("_start") + F.col("rank") - F.col("_first"))


def place(docs: DataFrame, old_shard: Column, *, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per document: id, ``size``, ``text_crc32``, ``old_shard``,
    ``shard``, ``slot``. ``old_shard`` is a small non-negative integer."""
    rows = _sized(docs, old_shard, text_col, _id=F.col(id_col))
    placed = _assigned(rows, *_plan(rows, shards), ["_id", "_crc", "_size"])
    return placed.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.col("_old").alias("old_shard"), "shard", F.col("_slot").alias("slot")
    )


def affected(placed: DataFrame) -> DataFrame:
    """Shards whose rows change: ``shard``, for arrivals and departures."""
    moved = placed.where("old_shard <> shard")
    return moved.select(F.explode(F.array("old_shard", "shard")).alias("shard")).distinct()


def rewrite(docs: DataFrame, old_shard: Column, path: str, *, text_col: str = "text", shards: int = SHARDS, rows_in_file: int = 100_000) -> list[int]:
    """Bring the layout at ``path``, a folder ``shard=N`` for each shard, to the
    new placement of ``docs``; the affected shards. ``docs`` may be read from
    ``path`` itself: the new files are written beside it and swapped in, shard by
    shard, when they are whole, and shards that no row leaves or enters are not
    touched. Rows travel whole, so ids need not be unique. A run that was
    interrupted while swapping is completed by `complete`."""
    complete(docs.sparkSession, path)
    cols = [c for c in docs.columns if c != "shard"]
    names = [f"_k{i}" for i in range(len(cols))]
    rows = _sized(docs, old_shard, text_col, **{n: F.col(f"`{c}`") for n, c in zip(names, cols, strict=True)})
    plan, total = _plan(rows, shards)
    touched = sorted({s for b, _, _, shard, _ in plan if b // 64 != shard for s in (b // 64, shard)})
    if not touched:
        return []
    # Rows of other shards stay where they are.
    some = _assigned(rows.where(F.col("_old").isin(touched)), [r for r in plan if r[0] // 64 in touched], total, ["_crc", "_size", names[0]])
    parts = some.withColumn("_file", F.floor(F.col("_slot") / rows_in_file)).repartition("shard", "_file")
    beside = f"{path}/_new-{uuid.uuid4().hex}"
    out = parts.select(*[F.col(n).alias(c) for n, c in zip(names, cols, strict=True)], "shard")
    out.write.partitionBy("shard").parquet(beside)
    storage.write_text(docs.sparkSession, f"{beside}/_touched", ",".join(map(str, touched)))
    complete(docs.sparkSession, path)
    return touched


def complete(spark: SparkSession, path: str) -> None:
    """Swap in what `rewrite` has written whole; drop what it has not. Each step
    is a rename, whose outcome tells a later run what is left to do. A reader may
    miss a shard between its two renames."""
    for name in storage.listing(spark, path):
        if not name.startswith("_new-"):
            continue
        beside = f"{path}/{name}"
        if storage.exists(spark, f"{beside}/_touched"):
            for shard in storage.read_text(spark, f"{beside}/_touched").split(","):
                new, now, old = f"{beside}/shard={shard}", f"{path}/shard={shard}", f"{beside}/_old-{shard}"
                # Without an old one yet, what is there is old, unless it is new already.
                if not storage.exists(spark, old) and storage.exists(spark, now) and (storage.exists(spark, new) or not storage.exists(spark, f"{beside}/_swapped-{shard}")):
                    storage.move(spark, now, old)
                if storage.exists(spark, new):
                    storage.write_text(spark, f"{beside}/_swapped-{shard}", "")
                    storage.move(spark, new, now)
        storage.delete(spark, beside)


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", old_shards: int = 16, shards: int = SHARDS) -> DataFrame:
    """Placement under the law ``rows`` from an old layout by source."""
    old = F.pmod(F.xxhash64(source_col), F.lit(old_shards))
    found = place(docs, old, id_col=id_col, text_col=text_col, shards=shards)
    return found.select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
