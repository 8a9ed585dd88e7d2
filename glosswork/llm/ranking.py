"""Row numbers and neighbours over a total order, without one task that sees every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glosswork.llm.storage import materialise

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in the low 33 bits


def ranked(df: DataFrame, group: list[str], order: list[Column], name: str, rank: str = "rank") -> DataFrame:
    """Add ``rank``: the row's place from 0 within its group, in the given order.

    Rows are dealt by range over group and order, so a group that holds a third of the rows spans many
    partitions. Each partition numbers its own rows; the counts of whole partitions (one row per partition
    and group, so bounded by partitions plus groups) give the offsets. Ties get numbers in any order, each once.
    """
    keys = [F.col(c).asc_nulls_first() for c in group] + list(order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _counted(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys), group, name, rank)


def numbered(df: DataFrame, group: list[str], name: str, rank: str = "rank", compression: str = "snappy") -> DataFrame:
    """Add ``rank``: a number from 0 for every row of a group, each once, in no stated order.

    As ``ranked``, but rows stay in their partitions. Here every partition may hold every group, so the counts are a table
    of partitions times groups: Spark broadcasts it only while its written size is below the session's threshold, and
    else joins it by shuffle.
    """
    return _counted(df.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in group]), group, name, rank, compression, few=False)


def join_counted(rows: DataFrame, named: DataFrame, key: str, count: str, columns: list[str]) -> DataFrame:
    """``columns`` of the inner join of rows with ``named``, which has one row a key and the key's number of rows in ``count``.

    A key of a thousandth of the rows or more is hot. There are a thousand of them at most, so these are broadcast and
    the rows of a hot key stay where they are; the others meet by shuffle, and no task gets more than a thousandth by one key.
    """
    total = rows.count()
    hot = F.col(count) * 1000 >= total
    rare = rows.join(F.broadcast(named.where(hot).select(key)), key, "left_anti")
    return rows.join(F.broadcast(named.where(hot)), key).select(columns).union(rare.join(named.where(~hot), key).select(columns))


def _counted(placed: DataFrame, group: list[str], name: str, rank: str, compression: str = "snappy", few: bool = True) -> DataFrame:
    """Ranks in partitions that are sorted by group, from a written table that fixes each row's place."""
    columns = placed.columns
    placed = materialise(placed.withColumn("_at", F.monotonically_increasing_id()), name, compression)
    placed = placed.withColumn("_part", F.shiftright("_at", _LOCAL_BITS)).withColumn(
        "_local", F.col("_at").bitwiseAND((1 << _LOCAL_BITS) - 1)
    )
    counts = placed.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_local").alias("_first"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    offsets = offsets.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
        F.col("_part").alias("_op"),
        (F.col("_before") - F.col("_first")).alias("_shift"),
    )
    match = F.col("_part") == F.col("_op")
    for i, c in enumerate(group):
        match = match & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    # dealt by range, a partition shares groups with its neighbours only: at most partitions + groups rows
    offsets = F.broadcast(offsets) if few else materialise(offsets, f"{name}-offsets")
    joined = placed.join(offsets, match)
    return joined.select(*columns, (F.col("_local") + F.col("_shift")).alias(rank))
