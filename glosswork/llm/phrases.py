"""Collocations of two to four words, mined best first under bounds from the counts of shorter phrases."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from glosswork.llm.hashing import text_chunks
from glosswork.llm.storage import materialise

# What ends a piece, what parts its words.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_CHUNK_CHARS = 1 << 21
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class PhraseParams:
    """What counts as a phrase, and how far the frontier is opened.

    ``filter_bits`` is the size (a power of two, as its logarithm) of the bit filters that go to the tasks. They only
    spare the counting of phrases that cannot matter; a filter that is too small for the corpus spares less.
    The frontier is opened down to the bound of rank ``widening`` * ``top``, then ``widening`` times as far, and so on.
    """

    longest: int = 4
    least_count: int = 30
    containment: tuple[int, int] = (80, 100)
    scale: int = 2_000_000
    top: int = 2000
    widening: int = 4
    filter_bits: int = 26


def _table(separators: bytes, value: int, table: np.ndarray) -> np.ndarray:
    table[np.frombuffer(separators, np.uint8)] = value
    return table


_KIND = _table(BLANKS, 1, _table(BREAKS, 2, np.zeros(256, np.uint8)))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The words of a chunk of texts in order: numbers of distinct (word, language), with their names and hashes."""

    ids: np.ndarray
    piece: np.ndarray
    names: pa.Array
    langs: pa.Array
    hashes: np.ndarray

    @staticmethod
    def of(texts: list[str], langs: list[str]) -> Words:
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = _LOWER[np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)]  # a text's end ends a piece
        kind = _KIND[data]
        inside = kind == 0
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        starts, ends = edges[::2], edges[1::2]
        piece = np.cumsum(kind == 2, dtype=np.int64)[starts]
        offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
        coded = words.dictionary_encode()
        known = pa.array(langs, pa.string()).dictionary_encode()
        text_of = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, np.cumsum([0, *(len(e) + 1 for e in encoded)]))))
        n_langs = max(len(known.dictionary), 1)
        keys = coded.indices.to_numpy().astype(np.int64) * n_langs + known.indices.to_numpy()[text_of]
        distinct, ids = np.unique(keys, return_inverse=True)
        names, lang_at = coded.dictionary.take(pa.array(distinct // n_langs)), distinct % n_langs
        lang_hashes = np.array([xxhash.xxh64_intdigest(x.as_py()) for x in known.dictionary], np.uint64)
        hashes = np.array([xxhash.xxh64_intdigest(x) for x in names.to_pylist()], np.uint64)
        return Words(ids, piece, names, known.dictionary.take(pa.array(lang_at)), hashes ^ (lang_hashes[lang_at] * _MIX))

    def runs(self, n: int) -> np.ndarray:
        """Where n words of one piece begin."""
        return np.flatnonzero(self.piece[n - 1 :] == self.piece[: len(self.piece) - n + 1]) if len(self.piece) >= n else np.zeros(0, np.int64)

    def counted(self, at: np.ndarray, n: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """(language, phrase, count) of the runs of n words that begin at the places."""
        number = self.ids[at]
        for k in range(1, n):  # numbers of distinct runs of k + 1 words, so that they never outgrow 64 bits
            pairs = number * np.int64(len(self.names)) + self.ids[at + k]
            first, number = np.unique(pairs, return_index=True, return_inverse=True)[1:] if k < n - 1 else (None, pairs)
        _, first, counts = np.unique(number, return_index=True, return_counts=True)
        where = at[first]
        parts = [self.names.take(pa.array(self.ids[where + k])) for k in range(n)]
        phrases = pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.large_binary())) if n > 1 else parts[0]
        return self.langs.take(pa.array(self.ids[where])), phrases, counts


def _pair_places(first: np.ndarray, second: np.ndarray, bits: int) -> np.ndarray:
    """The filter's bit of a pair of words with these hashes."""
    return ((first * _MIX ^ (second + _TURN) * _TURN) * _MIX >> np.uint64(64 - bits)).astype(np.int64)


def _word_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes * _MIX >> np.uint64(64 - bits)).astype(np.int64)


def _has(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def _bit_filter(phrases: DataFrame, p: PhraseParams) -> np.ndarray:
    """A bitmap of 2 ** ``filter_bits`` bits with the bits of the phrases (lang, phrase) of one or two words set.

    It is put together from at most 2 ** (``filter_bits`` - 6) rows of 64 bits, whatever the number of phrases.
    """
    bits = p.filter_bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            langs = np.array([digest(x) for x in batch.column(0).to_pylist()], np.uint64) * _MIX
            words = [x.split(b" ") for x in batch.column(1).to_pylist()]
            first = np.array([digest(w[0]) for w in words], np.uint64) ^ langs
            last = np.array([digest(w[-1]) for w in words], np.uint64) ^ langs
            alone = np.array([len(w) == 1 for w in words], bool)
            places = np.where(alone, _word_places(first, bits), _pair_places(first, last, bits))
            masks = (np.uint64(1) << (places & 63).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(places >> 6), pa.array(masks)], names=["block", "mask"])

    thin = phrases.select("lang", F.col("phrase").cast("binary").alias("phrase"))
    blocks = thin.mapInArrow(run, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toPandas()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[blocks["block"].to_numpy(np.int64)] = blocks["mask"].to_numpy(np.int64).view(np.uint64)
    return bitmap.view(np.uint8)


def _counts(texts: DataFrame, chosen: Callable[[Words], Iterator[tuple[int, np.ndarray]]]) -> DataFrame:
    """(lang, phrase, f): all occurrences of the phrases that ``chosen`` names by length and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, at = batch.column(0).to_pylist(), 0
            for chunk in text_chunks(batch.column(1), _CHUNK_CHARS):
                words = Words.of(chunk, langs[at : at + len(chunk)])
                at += len(chunk)
                for n, places in chosen(words):
                    lang, phrase, counts = words.counted(places, n)
                    yield pa.RecordBatch.from_arrays([lang, phrase.cast(pa.binary()), pa.array(counts)], names=["lang", "phrase", "f"])

    found = texts.mapInArrow(run, "lang string, phrase binary, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return found.select("lang", F.col("phrase").cast("string").alias("phrase"), "f")


def _words(phrase: Column) -> Column:
    return F.split(phrase, " ")


def _ratio(a: str, below: str, p: PhraseParams) -> Column:
    """floor(scale * a / below), in decimals: products may pass 64 bits."""
    return F.expr(f"cast({a} as decimal(20,0)) * cast({p.scale} as decimal(10,0)) div cast({below} as decimal(21,0))")


def _with_count(rows: DataFrame, part: str, known: DataFrame, into: str) -> DataFrame:
    """Add the count of the phrase in column ``part``; null where it is not known."""
    named = known.select("lang", F.col("phrase").alias(part), F.col("f").alias(into))
    return rows.join(named, ["lang", part], "left")


def _pair_bounds(two: DataFrame, words: DataFrame, p: PhraseParams) -> DataFrame:
    """Pairs with ``ahead`` and ``behind``: no longer phrase that begins, or ends, with the pair has a higher score.

    A phrase of count a that begins with a pair of count f and first word of count w has a <= f, and its cut after the
    first word has l = w and r >= a: its score is at most scale * f / (w + f). The mirrored bound holds at its end.
    """
    parts = two.select("lang", "phrase", "f", _words(F.col("phrase"))[0].alias("first"), _words(F.col("phrase"))[1].alias("last"))
    known = _with_count(_with_count(parts, "first", words, "w1"), "last", words, "w2")
    known = known.withColumn("ahead", _ratio("f", "w1 + f", p)).withColumn("behind", _ratio("f", "w2 + f", p))
    return known.select("lang", "phrase", "f", "ahead", "behind")


def _thresholds(bounds: DataFrame, rank: int) -> DataFrame:
    """(lang, least): the bound of the given rank among a language's pairs, 0 where there are fewer; by a histogram of bounds."""
    bars = bounds.groupBy("lang", F.greatest("ahead", "behind").alias("bound")).agg(F.count(F.lit(1)).alias("pairs"))
    so_far = F.sum("pairs").over(Window.partitionBy("lang").orderBy(F.desc("bound")))
    reached = bars.select("lang", "bound", so_far.alias("place"))
    return reached.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("place") >= rank, F.col("bound"))), F.lit(0)).alias("least"))


def _scored(candidates: DataFrame, known: DataFrame, p: PhraseParams) -> DataFrame:
    """Candidates (lang, phrase, f) with l, r and score of their lowest cut; those with a part that was not counted go."""
    words = _words(F.col("phrase"))
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), words.alias("ws"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("ws", F.lit(1), F.col("k")), " ").alias("left"),
        F.array_join(F.slice("ws", F.col("k") + 1, F.size("ws")), " ").alias("right"),
    )
    cuts = _with_count(_with_count(cuts, "left", known, "l"), "right", known, "r").withColumn("score", _ratio("a", "l + r", p))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"), F.bool_and(F.col("score").isNotNull()).alias("whole"))
    return best.where("whole").select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def _survivors(scored: DataFrame, longer: DataFrame, p: PhraseParams) -> DataFrame:
    """Those that no longer phrase of nearly their count contains. A phrase that contains one has a part of one word more that does, with no lower count."""
    words = _words(F.col("phrase"))
    within = longer.select("lang", "f", F.explode(F.array(*[F.array_join(F.slice(words, F.lit(k), F.size(words) - 1), " ") for k in (1, 2)])).alias("phrase"))
    most = within.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    share, whole = p.containment
    held = F.expr(f"cast({whole} as decimal(10,0)) * cast(longer as decimal(20,0)) >= cast({share} as decimal(10,0)) * cast(a as decimal(20,0))")
    return scored.join(most, ["lang", "phrase"], "left").where(~F.coalesce(held, F.lit(False))).drop("longer")


def _best(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language with their rank: first among a language's rows of one share, then among what these shares keep."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = scored.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(shares)))
    kept = shared.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    return kept.drop("share").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def _count_words(words: Words) -> Iterator[tuple[int, np.ndarray]]:
    yield 1, words.runs(1)


def _count_pairs(frequent, bits: int) -> Callable[[Words], Iterator[tuple[int, np.ndarray]]]:
    def chosen(words: Words) -> Iterator[tuple[int, np.ndarray]]:
        good = _has(frequent.value, _word_places(words.hashes, bits))[words.ids]
        at = words.runs(2)
        yield 2, at[good[at] & good[at + 1]]

    return chosen


def _count_longer(filters, p: PhraseParams) -> Callable[[Words], Iterator[tuple[int, np.ndarray]]]:
    """Longer phrases of frequent pairs that begin with a pair that is open ahead, or end with one that is open behind."""

    def chosen(words: Words) -> Iterator[tuple[int, np.ndarray]]:
        frequent, ahead, behind = filters.value
        at = words.runs(2)
        places = _pair_places(words.hashes[words.ids[at]], words.hashes[words.ids[at + 1]], p.filter_bits)
        good, opens, closes = (np.zeros(len(words.ids), bool) for _ in range(3))
        good[at], opens[at], closes[at] = (_has(x, places) for x in (frequent, ahead, behind))
        whole = good[:-1]
        for n in range(3, p.longest + 1):
            whole = whole[:-1] & good[n - 2 : -1]
            yield n, np.flatnonzero(whole & (opens[: len(whole)] | closes[n - 2 : -1]))

    return chosen


def top_phrases(docs: DataFrame, params: PhraseParams = PhraseParams(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language by the score of their lowest cut.

    Phrases of 2 to ``longest`` words that occur ``least_count`` times and are not held by a longer phrase of nearly
    their count. Best first: words, then pairs of frequent words are counted; a pair bounds the score of every longer
    phrase that begins or ends with it. The frontier of pairs is opened from the highest bound down to a threshold of
    each language, and the corpus read once for the phrases beyond it. Whatever scores the threshold or more is then known with all its
    parts and all that could hold it, so a language is settled when ``top`` survivors reach its threshold, ties included, or nothing
    is left to open. Languages that are not settled go on with a lower threshold.

    A null lang is ``und``, a null text has no words, repeated rows count each; other columns are not read. Phrases are
    counted as whole strings; bit filters only spare the counting of some that cannot matter.
    """
    p, spark = params, docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    share = lambda found: spark.sparkContext.broadcast(found)
    enough = F.col("f") >= p.least_count
    every = materialise(_counts(texts, _count_words), "phrase-words")
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    words = every.where(enough)
    two = materialise(_counts(texts, _count_pairs(share(_bit_filter(words, p)), p.filter_bits)).where(enough), "phrase-pairs")
    bounds = materialise(_pair_bounds(two, words, p), "phrase-bounds")
    waiting, rank, found = bounds, p.top, []
    while True:
        rank *= p.widening
        least = materialise(_thresholds(waiting, rank), "phrase-thresholds")
        pairs = waiting.join(least, "lang")
        filters = share(tuple(_bit_filter(x, p) for x in (pairs, pairs.where("ahead >= least"), pairs.where("behind >= least"))))
        longer = materialise(_counts(texts, _count_longer(filters, p)).where(enough), "phrase-longer")
        candidates = waiting.select("lang", "phrase", "f").union(longer)
        scored = _scored(candidates, words.union(candidates), p).join(least, "lang").where("score >= least")
        kept = materialise(_survivors(scored, longer, p), "phrase-survivors")
        reached = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("reached"))
        states = least.join(reached, "lang", "left").select("lang", ((F.col("least") == 0) | (F.col("reached") >= p.top)).alias("settled"))
        states = materialise(states.withColumn("settled", F.coalesce("settled", F.lit(False))), "phrase-states")
        found.append(kept.join(states.where("settled"), "lang", "left_semi").drop("least"))
        open_langs = states.where("not settled")
        if open_langs.isEmpty():
            break
        waiting = materialise(waiting.join(open_langs, "lang", "left_semi"), "phrase-bounds")
    settled = found[0]
    for more in found[1:]:
        settled = settled.union(more)
    return _best(settled, p.top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
