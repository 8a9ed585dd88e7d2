"""Numbers and running sums over a total order, without one task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from glosswork.sources.scratch import scratch_folder

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in the low 33 bits


def running(df: DataFrame, group: list[str], order: list[str | Column], sums: dict[str, Column]) -> DataFrame:
    """Add for each of ``sums`` the sum of its values up to and with the row, in the given order within the group.

    Null values count as 0. Rows are dealt by range over group and order, so that a group of any size spans many
    partitions; each partition sums its own rows, and the sums of the partitions before are added. Their table has
    partitions + groups rows at most, as partitions share groups with their neighbours only. Ties come in any order.
    """
    spark = df.sparkSession
    order = [F.col(c).asc() if isinstance(c, str) else c for c in order]
    keys = [F.col(c).asc_nulls_first() for c in group] + order
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = df.withColumns({f"_{n}": F.coalesce(v, F.lit(0)) for n, v in sums.items()})
    dealt = named.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    path = scratch_folder(spark, "ordered")  # a written table fixes each row's place
    dealt.write.parquet(path)
    rows = spark.read.schema(dealt.schema).parquet(path).withColumn("_part", F.shiftright("_at", _LOCAL_BITS))
    so_far = Window.partitionBy(*group, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*group, "_part").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    offsets = totals.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_part").alias("_p"),
        *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums],
    )
    match = F.col("_part") == F.col("_p")
    for i, c in enumerate(group):
        match = match & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    local = rows.withColumns({f"_here_{n}": F.sum(f"_{n}").over(so_far) for n in sums})
    added = [(F.col(f"_here_{n}") + F.col(f"_before_{n}")).alias(n) for n in sums]
    return local.join(F.broadcast(offsets), match).select(*[c for c in df.columns if c not in sums], *added)


def numbered(df: DataFrame, group: list[str], order: list[str | Column], name: str) -> DataFrame:
    """Add the row's number, from 1, within its group in the given order."""
    return running(df, group, order, {name: F.lit(1).cast("long")})
