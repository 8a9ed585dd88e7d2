"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from glosswork.llm.storage import discard, materialise_at, new_folder


def _directed(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands the smallest node around it to its larger neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, both.a == least.u).where("b > u").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour to its smaller neighbours and itself."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    joined = edges.join(least, edges.a == least.u)
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))


def connected_components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """Label each node of ``edges`` (a, b: long) with the smallest node it can reach: (node, label).

    Alternates large-star and small-star steps until the edges stop changing, which takes a number of rounds
    logarithmic in the longest path. Each round is a written table; the minima are partially aggregated before
    their shuffle and the joins are plain equi-joins, which adaptive execution splits when a hub is hot.
    Nodes without edges are not listed. Self-loops and repeated edges are ignored; an empty table gives none.
    """
    spark = edges.sparkSession
    path = new_folder(spark, name)
    current = materialise_at(_directed(edges.select("a", "b").where("a is not null and b is not null")), path)

    def state(df: DataFrame) -> tuple:
        digest = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        return tuple(df.agg(F.count(F.lit(1)), digest).first())

    seen = state(current)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        following = new_folder(spark, name)
        after = materialise_at(_directed(_small_star(_directed(_large_star(current)))), following)
        discard(spark, path)
        now, current, path = state(after), after, following
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.union(current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
