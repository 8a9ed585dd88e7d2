"""Best-fit packing of token pieces into fixed-length sequences by exact-complement hashing."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from glosswork.llm.hashing import text_chunks
from glosswork.llm.pretokens import PieceMemory
from glosswork.llm.ranking import ranked
from glosswork.llm.storage import materialise

Pattern = tuple[tuple[int, ...], int]  # the lengths in a sequence, and how many sequences have them

END_ID = 2
CAPACITY = 1024


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one from 256 on, in order."""
    seen = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(hidden)}


class TextIds:
    """Ids of texts as little-endian bytes, by the tokenizer's ids of their words.

    Words, which are split already, go to the tokenizer's model in its byte letters. A text that holds one of the
    tokenizer's added tokens goes to the tokenizer as a whole, which gives that token its id.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.memory = PieceMemory(self._of_words, ["<u4"])

    def _of_words(self, words: list[str]) -> list[list[bytes]]:
        model, letters, ids, ends = self.tokenizer.model, self.letters, [], [0]
        for word in words:
            ids += [t.id for t in model.tokenize(word.encode().decode("latin-1").translate(letters))]
            ends.append(4 * len(ids))
        packed = np.array(ids, "<u4").tobytes()
        return [[packed[a:b] for a, b in pairwise(ends)]]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        whole = [any(a in t for a in self.added) for t in texts]
        for text, w, (joined,) in zip(texts, whole, self.memory.join(["" if w else t for t, w in zip(texts, whole, strict=True)]), strict=True):
            yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() if w else joined


_TEXT_IDS: dict[str, TextIds] = {}


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32): every row's whole text as pieces of at most ``capacity`` ids.

    The ids are those of the tokenizer's plain call without special tokens, then END_ID; null texts are empty and give END_ID alone. Only
    longer documents are cut: into pieces of ``capacity``, but for the first, which takes what is left over.
    """
    thin = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(thin.dtypes)["id"]
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _TEXT_IDS:
            _TEXT_IDS[tokenizer_path] = TextIds(tokenizer_path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            at = 0
            for texts in text_chunks(batch.column(1), 1 << 22):
                for packed in _TEXT_IDS[tokenizer_path].encode(texts):
                    packed += end
                    total = len(packed) // 4
                    a, b, k = 0, (total - 1) % capacity + 1, 0
                    while a < total:
                        row.append(at)
                        piece.append(k)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(packed[4 * a : 4 * b]))
                        a, b, k = b, b + capacity, k + 1
                    at += 1
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32"])

    return thin.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def _exact_fills(left: np.ndarray, capacity: int, terms: int, floor: int, shortest: int) -> list[Pattern]:
    """Consume combinations that fill a sequence exactly from the availability counts ``left``.

    Longest first, every length from ``shortest`` on looks up its complement among single lengths, then (up to
    ``terms``) pair sums and triple sums of lengths from ``floor`` on, as often as the counts allow.
    """
    made: list[Pattern] = []

    def use(*lengths: int) -> None:
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = min(int(left[x]) // k for x, k in need.items())
        if times:
            for x, k in need.items():
                left[x] -= k * times
            made.append((lengths, times))

    use(capacity)
    for longest in range(capacity - 1, max(shortest, 1) - 1, -1):
        gap = capacity - longest
        if left[longest]:
            use(longest, gap)
        if left[longest] and terms > 1:  # pairs of sum gap, from equal ones on
            b = np.arange(floor, gap // 2 + 1)
            for x in b[(left[b] > 0) & (left[gap - b] > 0)][::-1].tolist():
                use(longest, gap - x, x)
                if not left[longest]:
                    break
        if left[longest] and terms > 2:  # triples a >= b >= c of sum gap, from equal ones on
            for a in range((gap + 2) // 3, gap - 2 * floor + 1):
                if not left[longest]:
                    break
                if not left[a]:
                    continue
                rest = gap - a
                c = np.arange(max(floor, rest - a), rest // 2 + 1)
                for x in c[(left[c] > 0) & (left[rest - c] > 0)][::-1].tolist():
                    use(longest, a, rest - x, x)
                    if not left[longest] or not left[a]:
                        break
    return made


def _best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Best-fit decreasing of what is left, in bulk: equal sequences are one group with a count."""
    open_gaps: list[int] = []  # sorted gaps that some open sequence has
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(lengths: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(lengths)
        if gap not in groups:
            groups[gap] = []
            insort(open_gaps, gap)
        groups[gap].append((lengths, times))

    for length in range(capacity - 1, 0, -1):
        n = int(left[length])
        while n and (k := bisect_left(open_gaps, length)) < len(open_gaps):
            gap = open_gaps[k]
            lengths, times = groups[gap].pop()
            if not groups[gap]:
                del groups[gap], open_gaps[k]
            if times > n:
                put(lengths, times - n)
                times = n
            put((*lengths, length), times)
            n -= times
        each = capacity // length
        if n >= each:
            put((length,) * each, n // each)
        if n % each:
            put((length,) * (n % each), 1)
    return [x for gap in open_gaps for x in groups[gap]]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Sequence patterns with their multiplicities for a histogram of lengths: [(lengths, times)].

    Exact complements are consumed first, then the residuals are packed best-fit. Consuming many short pieces early can
    leave long ones without company, so the plan is made for single complements alone and for pairs and triples of all
    or only of longer pieces, for lengths from half the capacity on and from a quarter on (four pieces that fill a
    sequence have one so long), and the one with the fewest sequences is returned. The work depends on the number of
    distinct lengths (at most ``capacity``), not on the number of pieces.
    """
    plans = []
    half, quarter = capacity // 2, -(-capacity // 4)
    for terms, floor, shortest in ((3, 1, half), (3, max(1, capacity * 15 // 100), half), (3, max(1, capacity // 4), half), (1, 1, half), (3, 1, quarter)):
        left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            left[length] += n
        made = _exact_fills(left, capacity, terms, floor, shortest)
        plans.append(made + _best_fit(left, capacity))
    return min(plans, key=lambda p: sum(times for _, times in p))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to (id, piece, start, length, ids_crc32).

    Only the histogram of lengths, at most ``capacity`` rows, reaches the driver. Every piece gets its number among those
    of its length in range partitions of these narrow rows, and the plan maps ranges of numbers to sequences and offsets, so no task
    sees more than its share. An empty table gives an empty table.
    """
    pieces = materialise(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for lengths, times in plan(counts, capacity):
        offset = 0
        for x in lengths:
            runs.setdefault(x, []).append((taken.get(x, 0), first, offset))
            taken[x] = taken.get(x, 0) + times
            offset += x
        first += times
    table = {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}
    ref = pieces.sparkSession.sparkContext.broadcast(table)  # runs of the plan: bounded by the capacity, not by the data

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                since, base, at = ref.value[int(x)]
                k = np.searchsorted(since, rank[rows], side="right") - 1
                sequence[rows] = base[k] + rank[rows] - since[k]
                offset[rows] = at[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    placed = ranked(pieces, ["length"], [F.xxhash64("id", "piece", "start", "ids_crc32")], "ranked-pieces")
    kind = dict(pieces.dtypes)["id"]
    return placed.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
