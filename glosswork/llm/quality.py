"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glosswork.llm.hashing import sums_by_text, text_chunks
from glosswork.llm.storage import materialise

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
SCALE = 10.0  # of the feature values, which are shares of the grams of a text


@dataclass(frozen=True)
class QualityParams:
    """``most_rows`` bounds the labelled rows that are learned from; the others steer the learner."""

    most_rows: int = 6000
    buckets: int = 1 << 18
    epochs: int = 5
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.002
    l2: float = 0.01
    seed: int = 5


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float


class _Words(dict):
    """Hash of each word; forgets all once it holds ``most`` of them, so that memory stays bounded."""

    most = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return value


_WORDS = _Words()


def _features(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the word uni- and bigrams of each text, text after text, and their number by text.

    Words are runs of letters and digits or of punctuation, lower-cased. A word that equals the one or two places
    before it also gives a gram that stands for any such repetition, whatever the word.
    """
    words = [TOKEN.findall(t.lower()) for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    hashed = np.fromiter((_WORDS[w] for ws in words for w in ws), np.uint32, int(counts.sum()))
    single = (hashed * np.uint32(0x9E3779B1)) >> np.uint32(7)
    pair = ((hashed[:-1] * np.uint32(0x85EBCA6B)) ^ (hashed[1:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F) >> np.uint32(5)
    owner = np.repeat(np.arange(len(words)), counts)
    same = owner[:-1] == owner[1:] if len(owner) else np.zeros(0, bool)
    grams, owners = [single % np.uint32(buckets)], [owner]
    if len(owner):
        grams.append(pair[same] % np.uint32(buckets))
        owners.append(owner[:-1][same])
        for gap in (1, 2):
            again = owner[gap:][(owner[:-gap] == owner[gap:]) & (hashed[:-gap] == hashed[gap:])]
            grams.append(np.full(len(again), gap - 1, np.uint32))
            owners.append(again)
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return grams[order].astype(np.int32), np.bincount(owners, minlength=len(texts)).astype(np.int64)


def _sparse(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    buckets, counts = np.unique(grams, return_counts=True)
    return buckets, SCALE * counts / max(1, counts.sum())


def _fit(examples: list[tuple[np.ndarray, np.ndarray, int]], p: QualityParams) -> QualityModel:
    """FTRL-proximal with per-coordinate rates; feature values are each gram's share of the text's grams, scaled."""
    z, n = np.zeros(p.buckets + 1), np.zeros(p.buckets + 1)  # the last place is the bias

    def weights_of(i: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[i]) * p.l1 - z[i]
        return np.where(np.abs(z[i]) <= p.l1, 0.0, shrunk / ((p.beta + np.sqrt(n[i])) / p.alpha + p.l2))

    rng = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for k in rng.permutation(len(examples)):
            at, share, y = examples[k]
            i, x = np.append(at, p.buckets), np.append(share, 1.0)
            w = weights_of(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / p.alpha
            z[i] += g - sigma * w
            n[i] += g * g
    final = weights_of(np.arange(p.buckets + 1))
    return QualityModel(final[:-1], float(final[-1]))


def train(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), learn: Column | None = None) -> QualityModel:
    """Fit on at most ``most_rows`` labelled documents, those whose ids hash lowest.

    ``labels`` has doc_id and quality (0 or 1; other values, nulls and documents with contradicting labels are left
    out). ``learn`` restricts the ids. Features are computed where the texts are; one task runs the learner over
    the bounded sample. With no usable label the model scores everything 0.5.
    """
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = (usable.where(learn) if learn is not None else usable).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("top"))
    order = F.xxhash64(F.lit(params.seed), "doc_id")
    sample = usable.where("y = top").select("doc_id", F.col("y").cast("int").alias("y"), order.alias("h")).orderBy("h", "doc_id").limit(params.most_rows)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")  # most_rows rows of 20 bytes

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ats, shares = [], []
            for chunk in text_chunks(batch.column(0)):
                grams, counts = _features(chunk, params.buckets)
                for part in np.split(grams, np.cumsum(counts)[:-1]):
                    at, share = _sparse(part)
                    ats.append(at)
                    shares.append(share.astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(ats, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["h", "y", "at", "share"])

    sparse = materialise(texts.select("text", "h", "y").mapInArrow(featurise, "h long, y int, at array<int>, share array<float>"), "quality-sample")

    def learner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for at, share, y in zip(b.column(2), b.column(3), b.column(1), strict=True):
                rows.append((at.values.to_numpy(), share.values.to_numpy().astype(np.float64), y.as_py()))
        m = _fit(rows, params)
        used = np.flatnonzero(m.weights).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([used]), pa.array([m.weights[used]]), pa.array([m.bias])], names=["at", "w", "bias"])

    one = sparse.repartition(1).sortWithinPartitions("h", F.hash("at"))
    fitted = materialise(one.mapInArrow(learner, "at array<int>, w array<double>, bias double"), "quality-model").toPandas()
    weights = np.zeros(params.buckets)
    bias = 0.0
    for at, w, b in zip(fitted["at"], fitted["w"], fitted["bias"], strict=True):
        weights[np.asarray(at, np.int64)] = w
        bias = b
    return QualityModel(weights, bias)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """Add quality_score (0 to 1) to every row: the sigmoid of the weights' mean over the whole text's grams.

    Null and empty texts have no grams and get the bias's score. A column of the same name is replaced.
    """
    docs = docs.drop("quality_score")
    model_ref = docs.sparkSession.sparkContext.broadcast(model)  # one double a bucket
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_ref.value
        for batch in batches:
            found = []
            for texts in text_chunks(batch.column(at)):
                grams, counts = _features(texts, len(m.weights))
                dots = SCALE * sums_by_text(m.weights[grams], counts) / np.maximum(counts, 1)
                found.append(1 / (1 + np.exp(-np.clip(dots + m.bias, -35, 35))))
            column = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, "quality_score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, quality_score double")
