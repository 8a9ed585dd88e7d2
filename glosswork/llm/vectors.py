"""Near-duplicate embeddings by a pigeonhole join over low-dimensional blocks of rotated vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from glosswork.llm.components import connected_components
from glosswork.llm.ranking import join_counted
from glosswork.llm.storage import materialise


@dataclass(frozen=True)
class PigeonholeParams:
    """Blocks of ``block_dims`` dimensions; cells are ``cell_widths`` times the block's distance budget wide (at least 2)."""

    least_cosine: float = 0.98
    block_dims: int = 8
    cell_widths: float = 4.0
    slack: float = 1e-5
    seed: int = 23


def _rotation(dims: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed + dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _blocks(vectors: np.ndarray, p: PigeonholeParams) -> np.ndarray:
    """Rotated unit vectors as [rows x blocks x block_dims], filled up with zeros."""
    dims = vectors.shape[1]
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ _rotation(dims, p.seed).T
    count = -(-dims // p.block_dims)
    padded = np.zeros((len(turned), count * p.block_dims))
    padded[:, :dims] = turned
    return padded.reshape(len(turned), count, p.block_dims)


def _cells(batch_ids: np.ndarray, salt: np.ndarray, blocks: np.ndarray, p: PigeonholeParams) -> Iterator[pa.RecordBatch]:
    """Rows of (cell, block, probe, id, x0..): for each block the vector's own cell, and every cell that its budget reaches.

    Two vectors within the whole squared distance are within the proportional budget in some block (pigeonhole), so there
    the cell of one is among the cells that the other reaches.
    """
    count = blocks.shape[1]
    radius = np.sqrt(2 * (1 - p.least_cosine) / count + p.slack)
    width = radius * p.cell_widths
    rng = np.random.default_rng(p.seed)
    weights = rng.integers(1, 1 << 62, p.block_dims, dtype=np.int64) | 1
    sides = ((np.arange(1 << p.block_dims)[:, None] >> np.arange(p.block_dims)) & 1).astype(np.int64)
    for b in range(count):
        x = blocks[:, b, :]
        cell = np.floor(x / width).astype(np.int64)
        inside = x / width - cell
        up = inside >= 0.5
        margin = np.where(up, 1 - inside, inside) * width
        with np.errstate(over="ignore"):
            own = (cell * weights).sum(axis=1) + salt + b * np.int64(0x9E3779B97F4A7C1)
            step = np.where(up, 1, -1) * weights
            reached = (margin**2) @ sides.T.astype(float) <= radius**2
            row, side = np.nonzero(reached)
            probes = own[row] + (step[row] * sides[side]).sum(axis=1)
        for probe, rows, key in ((False, np.arange(len(x)), own), (True, row, probes)):
            coordinates = [pa.array(x[rows, i].astype(np.float32)) for i in range(p.block_dims)]
            columns = [pa.array(key), pa.array(np.full(len(rows), b, np.int32)), pa.array(np.full(len(rows), probe)), pa.array(batch_ids[rows]), *coordinates]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "block", "probe", "rep", *[f"x{i}" for i in range(p.block_dims)]])


def usable_vectors(rows: DataFrame, vector_col: str = "vector", label_col: str = "label") -> DataFrame:
    """The rows that can link: label and vector (array<double>) given, finite and not zero."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.where(F.col(label_col).isNotNull() & (F.size(vector_col) > 0)).where(finite).where(F.exists(vector_col, lambda x: x != 0))


def candidate_pairs(classes: DataFrame, params: PigeonholeParams = PigeonholeParams()) -> DataFrame:
    """Distinct (a, b), a < b, of classes (rep, label, vector) whose distance in some block is within its budget.

    The join key is a hash of label, dimensions, block and cell, so only vectors of one label and one length meet (a hash
    clash only adds a candidate). It is a plain equi-join with a distance filter on the block's coordinates, which adaptive
    execution splits when a cell is hot.
    """
    dims = params.block_dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, salts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            flat, starts = batch.column(2).flatten().to_numpy(), np.cumsum(lengths) - lengths
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                for part in np.array_split(at, -(-len(at) // 2000)):
                    vectors = flat[starts[part][:, None] + np.arange(n)]
                    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
                    yield from _cells(ids[part], salts[part], _blocks(vectors, params), params)

    salted = classes.select("rep", F.xxhash64("label", F.size("vector")).alias("salt"), "vector")
    xs = [f"x{i}" for i in range(dims)]
    cells = salted.mapInArrow(run, "cell long, block int, probe boolean, rep long, " + ", ".join(f"{x} float" for x in xs))
    cells = materialise(cells, "vector-cells")
    own = cells.where("not probe").select("cell", "block", F.col("rep").alias("b"), *[F.col(x).alias(f"o{x}") for x in xs])
    reach = cells.where("probe").select("cell", "block", F.col("rep").alias("a"), *xs)
    squares = [(F.col(x) - F.col(f"o{x}")) * (F.col(x) - F.col(f"o{x}")) for x in xs]
    distance = squares[0]
    for s in squares[1:]:
        distance = distance + s
    sized = own.join(reach, ["cell", "block"]).where("a < b")
    sizes = classes.agg(F.min(F.size("vector")).alias("dims")).first()["dims"] or 1
    budget = 2 * (1 - params.least_cosine) / -(-sizes // dims) + 2 * params.slack  # of the shortest vectors, the widest
    return sized.where(distance <= budget).select("a", "b").distinct()


def verified_links(candidates: DataFrame, classes: DataFrame, least_cosine: float) -> DataFrame:
    """The pairs (a, b) of one label and length whose cosine, in double precision, is at least ``least_cosine``."""
    left = classes.select(F.col("rep").alias("a"), F.col("label").alias("la"), F.col("vector").alias("va"))
    right = classes.select(F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("vector").alias("vb"))
    pairs = candidates.join(left, "a").join(right, "b").where("la = lb and size(va) = size(vb)").select("a", "b", "va", "vb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, bool)
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            left_flat, right_flat = batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy()
            starts = np.cumsum(lengths) - lengths
            for n in np.unique(lengths):
                rows = np.flatnonzero(lengths == n)
                at = starts[rows][:, None] + np.arange(n)
                x, y = left_flat[at], right_flat[at]
                x, y = x / np.abs(x).max(axis=1, keepdims=True), y / np.abs(y).max(axis=1, keepdims=True)
                dots = np.einsum("ij,ij->i", x, y)
                good[rows] = dots / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)) >= least_cosine
            keep = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def near_duplicate_vectors(rows: DataFrame, params: PigeonholeParams = PigeonholeParams(), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept): one row per row of ``rows``.

    Vectors of one label link when their cosine is at least ``least_cosine``; vectors that are null, zero or hold null or
    non-finite parts, and rows without a label, link with nothing; vectors of different lengths are never compared.
    Equal vectors collapse to one class before the join, so a group of copies costs one vector; every link between
    different vectors is found and verified exactly. n_links counts the other rows linked directly, copies included.
    Every row is a vector of its own, also one that repeats an id or has none; a null id never names a component
    (one of null ids only has a null component_id) and is not kept.
    """
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    usable = usable_vectors(rows).withColumn("h", F.xxhash64("vector"))
    classes = usable.groupBy("label", "h", "vector").agg(F.min("row").alias("rep"), F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = materialise(classes, "vector-classes")
    links = materialise(verified_links(candidate_pairs(classes, params), classes, params.least_cosine), "vector-links")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = classes.select(F.col("rep").alias("b"), "copies")
    others = both.join(sizes, "b").groupBy("a").agg(F.sum("copies").alias("others"))
    labels = connected_components(links, "vector-edges").select(F.col("node").alias("rep"), F.col("label").alias("component"))
    grouped = classes.select("rep", "least").join(labels, "rep", "left").select("rep", "least", F.coalesce("component", "rep").alias("component"))
    named = grouped.join(grouped.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("rep", "component_id")
    known = classes.join(others, classes.rep == others.a, "left").join(named, "rep").select(
        F.struct("label", "h", "vector").alias("key"), "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id",
    )
    keyed = usable.select("row", "id", F.struct("label", "h", "vector").alias("key"))
    joined = join_counted(keyed, known, "key", "copies", ["row", "id", "n_links", "component_id"])
    alone = rows.join(joined.select("row"), "row", "left_anti").select("row", "id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    result = joined.select("row", "id", F.col("n_links").cast("long").alias("n_links"), "component_id").union(alone)
    return result.select("id", "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
