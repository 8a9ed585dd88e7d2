"""Near-duplicate groups by 64-bit SimHash and meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from glosswork.llm.components import connected_components
from glosswork.llm.ranking import join_counted
from glosswork.llm.storage import materialise

SEED = 42


def simhash64(text: str | None, words_per_shingle: int = 3) -> int:
    """Fingerprint of one text: bit i is 1 if it is set in over half the shingles' hashes.

    A-Z are lower-cased; words are runs of anything but ASCII white space. Fewer words than a shingle has give
    one shingle of them all; no words (null, empty, blanks) give fingerprint 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= words_per_shingle:
        return digest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = words_per_shingle - 1
    spans = zip(starts[: len(words) - last].tolist(), ends[last:].tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - last)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * set_bits > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((simhash64(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of each row's whole text as a signed long. Null texts count as empty."""
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return thin.mapInArrow(_fingerprint_batches, "id long, fp long")


def crowded_balls(distinct_fps: DataFrame) -> DataFrame:
    """(variant, members) of every ball of radius 1 that holds two fingerprints or more.

    Every fingerprint emits itself and its 64 one-bit variants; two fingerprints differ in at most two bits if
    and only if they share a variant. A variant's members are kept as one 64-bit mask of the flipped places, so
    a group is a fixed-size aggregate of at most 65 members.
    """
    masks = [1 << i for i in range(63)] + [-(1 << 63)]
    flips = F.explode(F.array(F.lit(0).cast("long"), *[F.lit(m).cast("long") for m in masks])).alias("flip")
    variants = distinct_fps.select("fp", flips).select(F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"), "flip")
    balls = variants.groupBy("variant").agg(
        F.bit_or("flip").alias("mask"), F.max((F.col("flip") == 0).cast("int")).alias("own")
    )
    crowded = balls.where(F.bit_count("mask") + F.col("own") > 1)
    flipped = F.array(*[F.when(F.col("mask").bitwiseAND(F.lit(m)) != 0, F.col("variant").bitwiseXOR(F.lit(m))) for m in masks])
    own = F.array(F.when(F.col("own") == 1, F.col("variant")))
    return crowded.select("variant", F.array_compact(F.concat(own, flipped)).alias("members"))


def fingerprint_links(distinct_fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints within two bits of each other.

    Each ball gives a star around its smallest member instead of all pairs: members of one ball are all within two
    bits, so components stay the same. The distance of every edge is verified.
    """
    edges = crowded_balls(distinct_fps).select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a <> b")
    return edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (id, fp, component_id), the last the smallest id reachable by links.

    Rows with equal fingerprints collapse to one node before anything is compared, so a group of copies that
    holds a third of the corpus costs one node. Null ids take part but never name a component (a component of
    null ids only has a null id); repeated ids stay repeated rows. Extra columns are not read. The result is
    exact for every pair within two bits.
    """
    thin = materialise(fingerprints(docs, id_col, text_col), "simhash-fp")
    nodes = materialise(thin.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-nodes")
    labels = connected_components(fingerprint_links(nodes.select("fp")), "simhash-edges")
    labelled = nodes.join(labels, nodes.fp == labels.node, "left").select(
        "fp", "n", "least", F.coalesce("label", "fp").alias("label")
    )
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = materialise(labelled.join(least, "label").select("fp", "n", "component_id"), "simhash-named")
    return join_counted(thin, named, "fp", "n", ["id", "fp", "component_id"])
