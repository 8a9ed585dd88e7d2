"""Near-duplicate groups by exact shingle similarity; SimHash balls and banded MinHash propose the pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from glosswork.llm.components import connected_components
from glosswork.llm.ranking import join_counted
from glosswork.llm.simhash import crowded_balls, simhash64
from glosswork.llm.storage import materialise

SEED = 42
_STEP = 256


@dataclass(frozen=True)
class ShingleParams:
    """Texts link when their sets of ``words_per_shingle`` words have a Jaccard similarity of ``least_similarity`` or more.

    All pairs whose SimHash fingerprints are within two bits are proposed. A pair of similarity s that is not among these is
    proposed with probability 1 - (1 - s ** rows) ** bands: 0.9999 at 0.8.
    """

    words_per_shingle: int = 5
    least_similarity: float = 0.8
    bands: int = 50
    rows: int = 8


def shingle_hashes(text: str | None, words_per_shingle: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles, with the words and short texts of ``simhash64``; none without a word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    width = min(words_per_shingle, len(words))
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    count = len(words) - width + 1
    mixed = np.full(count, width, np.uint64)
    for k in range(width):
        mixed = (mixed ^ hashes[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def set_key(hashes: np.ndarray) -> int:
    """A signed 64-bit hash of a whole set."""
    return xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def band_hashes(hashes: np.ndarray, params: ShingleParams) -> np.ndarray:
    """One hash for each band of MinHash values; none for an empty set."""
    if not len(hashes):
        return np.empty(0, np.int64)
    rng = np.random.default_rng(SEED)
    size = params.bands * params.rows
    turns, factors = (rng.integers(0, 1 << 64, size, dtype=np.uint64)[:, None] for _ in range(2))
    factors |= np.uint64(1)
    least = np.full(size, ~np.uint64(0))
    for at in range(0, len(hashes), _STEP):
        np.minimum(least, ((hashes[at : at + _STEP] ^ turns) * factors).min(axis=1), out=least)
    digest = xxhash.xxh3_64_intdigest
    banded = least.reshape(params.bands, params.rows)
    return np.fromiter((digest(b.tobytes(), i) for i, b in enumerate(banded)), np.uint64, params.bands).view(np.int64)


def _sketches(docs: DataFrame, params: ShingleParams) -> DataFrame:
    """(row, id, key, fp, bands, text) of each row; ``row`` is unique, ``fp`` the fingerprint of ``simhash64``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash64(t.as_py()) for t in batch.column(2)), np.uint64, batch.num_rows).view(np.int64)
            keys, bands = [], []
            for text in batch.column(2):
                hashes = shingle_hashes(text.as_py(), params.words_per_shingle)
                keys.append(set_key(hashes))
                bands.append(band_hashes(hashes, params))
            columns = [batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(fps), pa.array(bands, pa.list_(pa.int64())), batch.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "id", "key", "fp", "bands", "text"])

    return docs.mapInArrow(run, "row long, id long, key long, fp long, bands array<long>, text string")


def _ball_postings(sketches: DataFrame) -> DataFrame:
    """(key, bucket) of the sets in each ball of radius 1 that holds two or more: pairs within two bits share a ball, and no others do."""
    fps = materialise(sketches.select("key", "fp").distinct(), "shingle-fps")
    nodes = fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    several = nodes.where("n > 1").select(F.col("fp").alias("bucket"), "fp")  # sets of one fingerprint
    balls = crowded_balls(nodes.select("fp")).select(F.col("variant").alias("bucket"), F.explode("members").alias("fp"))
    return several.union(balls).join(fps, "fp").select("key", "bucket").distinct()


def _shingle_sets(texts: DataFrame, params: ShingleParams) -> DataFrame:
    """(key, shingles) of rows (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_hashes(t.as_py(), params.words_per_shingle).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["key", "shingles"])

    return texts.mapInArrow(run, "key long, shingles array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, params: ShingleParams) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y")).alias("shared")
    counted = pairs.join(left, "a").join(right, "b").select("a", "b", shared, (F.size("x") + F.size("y")).alias("both"))
    return counted.where(F.col("shared") >= params.least_similarity * (F.col("both") - F.col("shared"))).select("a", "b")


def _prefix_pairs(labelled: DataFrame, sets: DataFrame, params: ShingleParams) -> DataFrame:
    """Pairs (a, b) of rows (key, label) of different labels that can be similar enough: all such pairs, and few others.

    Put all shingles in one order. Two sets of n and m shingles with the least similarity s share ceil(s (n + m) / (1 + s)) or
    more, so the first shared one is among the first n - ceil(s n) + 1 of the one and m - ceil(s m) + 1 of the other, and
    enough follow it in both. Here the rarest come first, so a text's own edits stand before what it shares, and a large
    group of copies that are not similar enough to each other makes few pairs.
    """
    least = params.least_similarity
    at_least = lambda c: F.ceil(c - 1e-9).cast("int")
    rows = labelled.select("key", "label").distinct().join(sets, "key").select("key", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    rows = materialise(rows, "shingle-rows")
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = rows.join(shared, "shingle").groupBy("key", "label", "n").agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("shared"))
    alone = F.col("n") - F.size("shared")  # shingles of no other text come before
    first = F.col("n") - at_least(F.col("n") * least) + 1 - alone
    prefix = known.where(first > 0).select("key", "label", "n", alone.alias("alone"), F.posexplode(F.slice("shared", F.lit(1), first)).alias("at", "x"))
    prefix = materialise(prefix.select("key", "label", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("left"), "x.shingle"), "shingle-prefixes")
    other = prefix.select(F.col("key").alias("b"), F.col("label").alias("other"), F.col("n").alias("m"), F.col("left").alias("also_left"), "shingle")
    enough = F.least("left", "also_left") >= at_least((F.col("n") + F.col("m")) * (least / (1 + least)))
    return prefix.join(other, "shingle").where((F.col("key") < F.col("b")) & (F.col("label") != F.col("other")) & enough).select(F.col("key").alias("a"), "b").distinct()


def near_duplicate_groups(docs: DataFrame, params: ShingleParams = ShingleParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, key, component_id), the last the smallest id reachable by links.

    Equal sets of shingles collapse to one node. Nodes that share a bucket are candidates, and every link is verified on the
    whole sets. Buckets are the balls of radius 1 around SimHash fingerprints, and the hashes of MinHash bands for pairs more than
    two bits apart. Each bucket is first compared with its busiest node, whose similarity to
    most others joins a large group without all its pairs. Of the members of buckets that still hold several components, those
    pairs of different components are compared whose rarest shingles meet, so no candidate that is similar enough is left
    out. Null ids take part but never name a component.
    """
    thin = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = materialise(_sketches(thin, params), "shingle-sketches", "zstd")
    nodes = materialise(sketches.groupBy("key").agg(F.min("id").alias("least"), F.min("row").alias("row"), F.count(F.lit(1)).alias("n")), "shingle-nodes")
    own = sketches.select("row", "bands").join(nodes.select("key", "row"), "row")
    postings = own.select("key", F.explode("bands").alias("bucket")).union(_ball_postings(sketches))
    crowded = postings.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialise(postings.join(crowded, "bucket").select("bucket", "key", "n"), "shingle-buckets")
    wanted = members.select("key").distinct().join(nodes.select("key", "row"), "key")
    texts = sketches.select("row", "text").join(wanted, "row").select("key", "text")
    sets = materialise(_shingle_sets(texts, params), "shingle-sets")

    weights = members.groupBy("key").agg(F.sum("n").alias("weight"))
    centres = members.join(weights, "key").groupBy("bucket").agg(F.max(F.struct("weight", "key"))["key"].alias("centre"))
    rays = members.join(centres, "bucket").where("key <> centre")
    tried = materialise(rays.select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct(), "shingle-rays")
    links = materialise(_verified(tried, sets, params), "shingle-links")
    labels = connected_components(links, "shingle-edges")
    labelled = members.join(labels, members.key == labels.node, "left").select("bucket", "key", F.coalesce("label", "key").alias("label"))
    split = labelled.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    apart = materialise(labelled.join(split.select("bucket"), "bucket"), "shingle-apart")
    rest = _prefix_pairs(apart, sets, params).join(tried, ["a", "b"], "left_anti")
    more = materialise(_verified(materialise(rest, "shingle-rest"), sets, params), "shingle-more")

    labels = connected_components(links.union(more), "shingle-edges")
    named = nodes.join(labels, nodes.key == labels.node, "left").select("key", "n", "least", F.coalesce("label", "key").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = materialise(named.join(least, "label").select("key", "n", "component_id"), "shingle-named")
    return join_counted(sketches.select("id", "key"), found, "key", "n", ["id", "key", "component_id"])
