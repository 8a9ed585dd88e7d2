"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from glosswork.llm.hashing import hash_unit, sums_by_text, text_chunks
from glosswork.llm.storage import materialise

UNDETERMINED = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LangIdParams:
    """``rows_per_language`` bounds the training sample (in expectation). All languages are learned; a column of more than
    ``most_languages`` values is taken for a mistake.
    """

    rows_per_language: int = 500
    most_languages: int = 10_000
    buckets: int = 1 << 16
    dims: int = 16
    epochs: int = 4
    rate: float = 0.5
    calibration_share: float = 0.2
    rejected_share: float = 0.001
    most_strict: float = 0.5
    seed: int = 11


@dataclass(frozen=True)
class LangIdModel:
    languages: tuple[str, ...]
    table: np.ndarray  # buckets x languages: each bucket's embedding times the softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float


def _subwords(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 2-, 3- and 4-grams of letters of every word with its borders, and their number by text.

    A gram may start or end at a word's border but never spans one.
    """
    words = [" " + NOT_LETTERS.sub(" ", t.lower()).strip() + " " for t in texts]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(words)), lengths)
    gap = codes == 32
    mixed = codes * np.uint32(0x9E3779B1)
    grams, owners = [], []
    rolled = mixed
    for n in (2, 3, 4):
        size = len(codes) - n + 1
        if size <= 0:
            break
        rolled = (rolled[:size] ^ (rolled[:size] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + mixed[n - 1 :]
        inside = ~(gap[:size] & gap[n - 1 :])
        for k in range(1, n - 1):
            inside &= ~gap[k : k + size]
        inside &= owner[:size] == owner[n - 1 :]
        hashed = rolled[inside]
        hashed = (hashed ^ (hashed >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        grams.append(((hashed ^ (hashed >> np.uint32(16))) % np.uint32(buckets)).astype(np.int32))
        owners.append(owner[:size][inside])
    if not grams:
        return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return grams[order], np.bincount(owners, minlength=len(texts))


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _fit(texts: list[str], langs: list[str], p: LangIdParams) -> LangIdModel:
    rng = np.random.default_rng(p.seed)
    names = tuple(sorted(set(langs)))
    index = {x: i for i, x in enumerate(names)}
    embed = rng.normal(0, 0.05, (p.buckets, p.dims)).astype(np.float32)
    weights = rng.normal(0, 0.05, (p.dims, len(names))).astype(np.float32)
    seen = np.zeros(p.buckets, bool)
    bias = np.zeros(len(names), np.float32)
    held = rng.random(len(texts)) < p.calibration_share
    if held.all() or not held.any():
        held[:] = False
    examples = []
    for text, lang, out in zip(texts, langs, held, strict=True):
        words = text.split()
        if out or not words:
            continue
        start = int(rng.integers(len(words)))
        for piece in (text, " ".join(words[start : start + int(rng.integers(1, 25))])):
            grams, _ = _subwords([piece], p.buckets)
            if len(grams):
                buckets, counts = np.unique(grams, return_counts=True)
                seen[buckets] = True
                examples.append((buckets, (counts / counts.sum()).astype(np.float32), index[lang]))
    steps, at = max(1, p.epochs * len(examples)), 0
    for _ in range(p.epochs):
        for k in rng.permutation(len(examples)):
            buckets, share, y = examples[k]
            rate = p.rate * (1 - at / steps)
            at += 1
            hidden = share @ embed[buckets]
            error = _softmax(hidden @ weights + bias)
            error[y] -= 1
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= rate * 0.01 * error
            embed[buckets] -= (rate * 20) * np.outer(share, back)
    embed[~seen] = 0  # an unseen subword says nothing
    table = (embed @ weights).astype(np.float64)
    model = LangIdModel(names, table, bias.astype(np.float64), 1.0, 0.0)
    check = [i for i, out in enumerate(held) if out and LETTER.search(texts[i])] or [i for i in range(len(texts)) if LETTER.search(texts[i])]
    if not check:
        return model
    logits = _logits([texts[i] for i in check], model)
    truth = np.array([index[langs[i]] for i in check])
    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    sure = _softmax(logits / temperature)
    right = sure[np.arange(len(truth)), truth][sure.argmax(axis=1) == truth]
    threshold = min(p.most_strict, float(np.quantile(right, p.rejected_share))) if len(right) else 0.0
    return LangIdModel(names, table, model.bias, temperature, threshold)


def _logits(texts: list[str], model: LangIdModel) -> np.ndarray:
    grams, counts = _subwords(texts, len(model.table))
    return sums_by_text(model.table[grams], counts) / np.maximum(counts, 1)[:, None] + model.bias


def train(docs: DataFrame, learn: Column, params: LangIdParams = LangIdParams(), id_col: str = "doc_id") -> LangIdModel:
    """Fit on a bounded sample of the rows where ``learn`` holds and lang and text are not null.

    The sample takes each language's rows by a hash of the id, ``rows_per_language`` of each in expectation, and one task
    fits it by stochastic gradient descent; nothing but the
    weights (buckets x languages) reaches the driver. Part of the sample is kept aside to fit the softmax
    temperature and the rejection threshold: the ``rejected_share`` quantile of the confidence of right answers,
    never above ``most_strict``. Without usable rows the model knows no language and calls every text ``und``; more
    than ``most_languages`` values of lang raise ValueError.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(params.most_languages + 1)
    shares = {r["lang"]: params.rows_per_language / r["n"] for r in counts.collect()}
    if len(shares) > params.most_languages:
        raise ValueError(f"lang has more than {params.most_languages} values")
    unknowing = LangIdModel((), np.zeros((params.buckets, 0)), np.zeros(0), 1.0, 0.0)
    if not shares:
        return unknowing
    share = F.element_at(F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]), F.col("lang"))
    sample = rows.where(hash_unit(id_col, params.seed) < share).select(F.col(id_col).alias("id"), "lang", "text")
    sample = sample.repartition(1).sortWithinPartitions("id", "lang", "text")

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(t, x) for f in frames for t, x in zip(f["text"], f["lang"], strict=True)]
        m = _fit([t for t, _ in rows], [x for _, x in rows], params)
        yield pd.DataFrame({"languages": [list(m.languages)], "shape": [list(m.table.shape)], "weights": [m.table.tobytes()], "bias": [m.bias.tolist()], "temperature": m.temperature, "threshold": m.threshold})

    schema = "languages array<string>, shape array<int>, weights binary, bias array<double>, temperature double, threshold double"
    r = materialise(sample.mapInPandas(fit, schema), "langid-model").first()
    if not r or not r["languages"]:
        return unknowing
    table = np.frombuffer(bytes(r["weights"])).reshape(r["shape"])
    return LangIdModel(tuple(r["languages"]), table, np.array(r["bias"]), r["temperature"], r["threshold"])


def predict(docs: DataFrame, model: LangIdModel, text_col: str = "text") -> DataFrame:
    """Add lang_pred, lang_score and lang_accepted to every row, reading its whole text and nothing else.

    A text that is null or has no letter is ``und`` with score 0 and is rejected, and so is every text under a model
    without languages. Others get the likeliest learned
    language, its calibrated probability, and are rejected when that is below the model's threshold. Columns of
    the same names are replaced. Empty tables give empty tables.
    """
    added = ["lang_pred", "lang_score", "lang_accepted"]
    docs = docs.drop(*added)
    model_ref = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages weights, bounded by the parameters
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model_ref.value
        for batch in batches:
            names, scores = [], []
            for texts in text_chunks(batch.column(at)):
                if not m.languages:
                    names += [UNDETERMINED] * len(texts)
                    scores += [0.0] * len(texts)
                    continue
                sure = _softmax(_logits(texts, m) / m.temperature)
                best = sure.argmax(axis=1)
                known = [LETTER.search(t) is not None for t in texts]
                names += [m.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
                scores += [float(s[b]) if k else 0.0 for s, b, k in zip(sure, best, known, strict=True)]
            kept = [n != UNDETERMINED and s >= m.threshold for n, s in zip(names, scores, strict=True)]
            extra = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(kept, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, lang_score double, lang_accepted boolean")
