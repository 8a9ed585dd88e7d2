"""Resharding with the fewest moved bytes: a minimum-cost flow over blocks of rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from glosswork.llm.ranking import numbered
from glosswork.llm.storage import new_folder

Block = tuple[int, int]  # old shard, size class


@dataclass(frozen=True)
class Move:
    """Rows [since, since + n) of a block go to ``shard``."""

    block: Block
    since: int
    n: int
    shard: int


def capacities(old_rows: dict[int, int], shards: int) -> list[int]:
    """Rows of each new shard: counts differ by one at most; the larger ones go to the shards that hold most rows."""
    total = sum(old_rows.values())
    order = sorted(range(shards), key=lambda s: (-old_rows.get(s, 0), s))
    extra = set(order[: total % shards])
    return [total // shards + (s in extra) for s in range(shards)]


def min_cost_flow(supply: np.ndarray, demand: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Integral flow [sources x sinks] that meets supply and demand (equal sums) at least total cost.

    Successive shortest augmenting paths with potentials over the dense residual graph.
    """
    n, m = cost.shape
    flow = np.zeros((n, m), np.int64)
    left, room = supply.astype(np.int64).copy(), demand.astype(np.int64).copy()
    from_potential, to_potential = np.zeros(n), cost.min(axis=0) if n else np.zeros(m)
    while left.any():
        far = np.inf
        dist = np.concatenate((np.where(left > 0, 0.0, far), np.full(m, far)))
        before = np.full(n + m, -1)
        done = np.zeros(n + m, bool)
        while True:
            at = int(np.argmin(np.where(done, far, dist)))
            if done[at] or dist[at] == far:
                break
            done[at] = True
            if at < n:
                reach = dist[at] + np.maximum(cost[at] + from_potential[at] - to_potential, 0)
                better = reach < dist[n:]
                dist[n:][better], before[n:][better] = reach[better], at
            else:
                t = at - n
                reach = np.where(flow[:, t] > 0, dist[at] + np.maximum(to_potential[t] - from_potential - cost[:, t], 0), far)
                better = reach < dist[:n]
                dist[:n][better], before[:n][better] = reach[better], at
        ends = np.where(room > 0, dist[n:] + to_potential, far)
        t = int(np.argmin(ends))
        finite = np.where(np.isfinite(dist), dist, dist[np.isfinite(dist)].max())
        path, at = [], n + t
        while before[at] >= 0:
            path.append((int(before[at]), at))
            at = int(before[at])
        amount = min(int(left[at]), int(room[t]), *[int(flow[b, a - n]) for a, b in path if a >= n])
        for a, b in path:
            if a < n:
                flow[a, b - n] += amount
            else:
                flow[b, a - n] -= amount
        left[at] -= amount
        room[t] -= amount
        from_potential += finite[:n]
        to_potential += finite[n:]
    return flow


def plan_moves(blocks: dict[Block, tuple[int, int]], shards: int) -> list[Move]:
    """Block transfers for blocks {(old shard, size class): (rows, bytes)} and equal row counts in the new shards.

    A row that stays in the shard of its old number costs nothing, any other its block's mean bytes. Each block's rows
    are dealt in order of the new shard.
    """
    names = sorted(blocks)
    old_rows: dict[int, int] = {}
    for (s, _), (n, _) in blocks.items():
        old_rows[s] = old_rows.get(s, 0) + n
    room = capacities(old_rows, shards)
    cost = np.array([[0.0 if s == t else blocks[s, c][1] / blocks[s, c][0] for t in range(shards)] for s, c in names]).reshape(len(names), shards)
    flow = min_cost_flow(np.array([blocks[b][0] for b in names]), np.array(room), cost)
    moves = []
    for i, b in enumerate(names):
        since = 0
        for t in range(shards):
            if flow[i, t]:
                moves.append(Move(b, since, int(flow[i, t]), t))
                since += int(flow[i, t])
    return moves


def reshard(rows: DataFrame, shards: int, folder: str | None = None, bytes_per_file: int = 1 << 25) -> DataFrame:
    """Move rows of (old_shard: int, size: long, ...) to ``shards`` shards of equal row counts; adds shard and slot.

    A block is the rows of one old shard whose sizes have the same power of two, so there are at most old shards x 63.
    Rows are laid out by block in a written table (the old files) and numbered there by their place, without a shuffle;
    the flow over the blocks' rows and bytes is solved on the driver; its moves, at most blocks + shards, map numbers to
    new shards and gapless slots. Only shards that lose or gain rows are rewritten below ``folder``, in files of about
    ``bytes_per_file`` of rows of mixed sizes, as many tasks as files; the others' rows are read where they are. Sizes must be positive. An empty
    table gives an empty one.
    """
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c not in ("shard", "slot", "size_class")]
    classed = rows.select(*columns, F.floor(F.log2("size")).cast("int").alias("size_class"))
    old = numbered(classed, ["old_shard", "size_class"], "old-shards", rank="block_rank", compression="zstd")
    sums = old.groupBy("old_shard", "size_class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()
    moves = plan_moves({(r["old_shard"], r["size_class"]): (r["n"], r["bytes"]) for r in sums}, shards)
    filled, table = dict.fromkeys(range(shards), 0), []
    for m in sorted(moves, key=lambda m: (m.shard, m.block)):
        table.append((*m.block, m.since, m.since + m.n, m.shard, filled[m.shard] - m.since))
        filled[m.shard] += m.n
    kinds = [("old_shard", IntegerType()), ("size_class", IntegerType()), ("since", LongType()), ("until", LongType()), ("shard", IntegerType()), ("shift", LongType())]
    moved = spark.createDataFrame(table, StructType([StructField(n, k) for n, k in kinds]))
    within = (F.col("block_rank") >= F.col("since")) & (F.col("block_rank") < F.col("until"))
    placed = old.join(F.broadcast(moved), ["old_shard", "size_class"]).where(within)  # at most blocks + shards moves
    placed = placed.select(*columns, "shard", (F.col("block_rank") + F.col("shift")).alias("slot"))
    changed = sorted({x for m in moves if m.shard != m.block[0] for x in (m.shard, m.block[0])} & set(range(shards)))
    folder = folder or new_folder(spark, "shards")
    files = 1 + sum(r["bytes"] for r in sums) // (shards * bytes_per_file)
    moving = placed.where(F.col("shard").isin(changed))
    file = F.col("shard") * files + F.pmod("slot", F.lit(files))  # a task each, none with two by a clash of hashes
    moving.repartitionById(shards * files, file.cast("int")).write.partitionBy("shard").parquet(folder, compression="zstd")
    rewritten = spark.read.schema(placed.schema).parquet(folder).select(placed.columns)
    return rewritten.union(placed.where(~F.col("shard").isin(changed)))


def document_shards(docs: DataFrame, old_shards: int = 16, shards: int = 24) -> DataFrame:
    """(doc_id, text, size, shard, slot) after documents, laid out by a hash of their source, are resharded by rows.

    The size is the text's UTF-8 bytes (null: none) plus 8. Null sources are one source. The hot source makes the old
    shards very uneven; new ones differ by one row at most.
    """
    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id"),
        text.alias("text"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.pmod(F.xxhash64("source"), F.lit(old_shards)).cast("int").alias("old_shard"),
    )
    return reshard(rows, shards).drop("old_shard")
