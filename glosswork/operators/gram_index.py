"""An inverted index of character trigrams, kept as tables: which rows may contain a needle, without reading the others."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from glosswork.sources.scratch import fixed, scratch_folder

GRAM = 3
_BLOCK_BITS = 15  # a posting list stays in a block of 32,768 rows, so its places fit a smallint and it is bounded a row
_PLACE = (1 << _BLOCK_BITS) - 1
_SLICE = 1 << 20  # characters whose grams a task sorts at once; a longer row has a slice of its own
_SPREAD = 4  # a folder of posting lists is made by so many keys, as some characters begin many grams


def folded(text: Column) -> Column:
    """Lower case, with one small sigma, so that equal needles fold alike wherever they stand in a word."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def _slices(numbers: np.ndarray, tiers: np.ndarray, sizes: np.ndarray):
    """(start, stop) of runs of rows of one block and tier, of about ``_SLICE`` characters each."""
    same = (numbers >> _BLOCK_BITS, tiers, (np.cumsum(sizes) - sizes) // _SLICE)
    cuts = np.flatnonzero(np.any([np.diff(x) != 0 for x in same], axis=0)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(numbers)], strict=True)


def _lists(batches):
    """Posting lists (gram, tier, chunk, rows) of Arrow batches of a row's number, tier and folded texts, for each slice of rows.

    A chunk is named by its first row's number; rows are places in the block of that number, ascending and distinct.
    """
    for batch in batches:
        numbers, tiers = (batch.column(i).to_numpy() for i in range(2))
        columns = [c.to_pylist() for c in batch.columns[2:]]
        sizes = np.sum([[len(t or "") for t in c] for c in columns], axis=0)
        for start, stop in _slices(numbers, tiers, sizes) if len(numbers) else ():
            texts = [t or "" for c in columns for t in c[start:stop]]
            lengths = np.array([len(t) for t in texts])
            points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
            if not len(points):
                continue
            used = np.zeros(0x110000, bool)
            used[points] = True
            letters, base = ["", *map(chr, np.flatnonzero(used).tolist())], int(used.sum()) + 1
            letter = np.append(np.cumsum(used)[points], np.zeros(GRAM, np.int64))  # its number among the slice's letters, 0 past the end
            left, code = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(points)), letter[: len(points)]
            for k in range(1, GRAM):
                code = code * base + np.where(left > k, letter[k : k + len(points)], 0)
            names = None
            if base**GRAM >> (63 - _BLOCK_BITS):  # too many letters for a gram and a place in one number
                names, code = np.unique(code, return_inverse=True)
            places = np.repeat(np.tile(numbers[start:stop] & _PLACE, len(columns)), lengths)
            pairs = np.sort((code << _BLOCK_BITS) | places)
            pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
            first = np.flatnonzero(np.append(True, np.diff(pairs >> _BLOCK_BITS) != 0))
            code = pairs[first] >> _BLOCK_BITS
            code = code if names is None else names[code]
            grams = ["".join(letters[i] for i in g) for g in zip(*[(code // base**k % base).tolist() for k in reversed(range(GRAM))], strict=True)]
            rows = pa.ListArray.from_arrays(np.append(first, len(pairs)).astype(np.int32), (pairs & _PLACE).astype(np.int16))
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), *(pa.array(np.full(len(first), x[start])) for x in (tiers, numbers)), rows], ["gram", "tier", "chunk", "rows"])


class GramIndex:
    """The rows and the posting lists of their texts below a folder that the cluster shares.

    ``rows`` are kept in folders by tier and block, posting lists (gram, tier, chunk, rows) in folders by the gram's first
    character, sorted by gram, so that a search opens the folders of its needle and skips other grams by file statistics.
    A row's grams are all in one chunk, so lists are made and intersected a chunk at a time and never joined across them.
    """

    def __init__(self, spark: SparkSession, path: str, folders: int = 64):
        self.spark, self.path, self.folders = spark, path.rstrip("/"), folders
        self._tables: dict[str, DataFrame] = {}

    def _table(self, name: str) -> DataFrame:
        """A table of the index; its files are listed once."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.path}/{name}")
        return self._tables[name]

    def _folder(self, row: Column) -> Column:
        """The folder of a row's block; the high bits of its number are the task that numbered it."""
        return F.pmod(F.shiftright(row, _BLOCK_BITS) + F.shiftright(row, 33), F.lit(self.folders))

    def build(self, rows: DataFrame, texts: list[str], tier: str | None = None) -> None:
        """Index the columns ``texts`` of all rows; a null text has no grams. ``tier`` is a whole number, never null, see ``best``.

        A text has a gram at each of its characters: the next three characters, or what is left at its end.
        """
        numbered = rows.withColumns({"_row": F.monotonically_increasing_id(), "_tier": F.col(tier) if tier else F.lit(0)})
        numbered.withColumn("_folder", self._folder(F.col("_row"))).write.partitionBy("_tier", "_folder").parquet(f"{self.path}/rows")
        read = self._table("rows").select("_row", F.col("_tier").cast("bigint"), *[folded(F.col(c)).alias(f"t{i}") for i, c in enumerate(texts)])
        lists = read.mapInArrow(_lists, "gram string, tier bigint, chunk bigint, rows array<smallint>")
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        placed = lists.withColumn("_folder", F.ascii("gram") % self.folders).repartition(parts, "_folder", F.pmod(F.hash("chunk"), F.lit(_SPREAD)))
        placed.sortWithinPartitions("_folder", "gram", "chunk").write.partitionBy("_folder").parquet(f"{self.path}/postings")

    def postings(self, needle: str) -> DataFrame:
        """The posting lists that a folded needle needs: of all its grams, or of the grams that begin with a shorter one."""
        grams = sorted({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)}) or [needle]
        of_needle = F.col("gram").startswith(needle) if len(needle) < GRAM else F.col("gram").isin(grams)
        return self._table("postings").where(F.col("_folder").isin(sorted({ord(g[0]) % self.folders for g in grams})) & of_needle)

    def _hits(self, needle: str) -> tuple[DataFrame, dict[tuple[int, int], int]]:
        """The numbers of the rows that may contain the needle, and how many they are by tier and folder."""
        needle = self.spark.sql("select 1").select(folded(F.lit(needle))).first()[0]
        if not needle:
            return self.spark.createDataFrame([], "_row bigint, tier bigint"), {}
        lists = self.postings(needle).groupBy("tier", "chunk").agg(F.collect_list("rows").alias("lists"))
        if len(needle) < GRAM:
            common = F.array_distinct(F.flatten("lists"))
        else:
            lists = lists.where(F.size("lists") == len({needle[i : i + GRAM] for i in range(len(needle) - GRAM + 1)}))
            common = F.aggregate(F.slice("lists", F.lit(2), F.greatest(F.size("lists") - 1, F.lit(1))), F.col("lists")[0], lambda a, b: F.array_intersect(a, b))
        block = F.shiftleft(F.shiftright("chunk", _BLOCK_BITS), _BLOCK_BITS)
        found = lists.select("tier", block.alias("block"), F.explode(common).alias("place")).select((F.col("block") + F.col("place")).alias("_row"), "tier")
        path = scratch_folder(self.spark, "gram-hits")
        found.write.parquet(path)
        hits = self.spark.read.schema(found.schema).parquet(path)
        counts = hits.groupBy("tier", self._folder(F.col("_row")).alias("folder")).count()
        return hits, {(r["tier"], r["folder"]): r["count"] for r in counts.collect()}

    def _rows(self, hits: DataFrame, opened: list[tuple[int, int]]) -> DataFrame:
        """The indexed rows of the hits in the opened tiers and folders."""
        tiers = {t: sorted(f for x, f in opened if x == t) for t, _ in opened}
        kept = reduce(Column.__or__, [(F.col("_tier") == t) & F.col("_folder").isin(fs) for t, fs in tiers.items()], F.lit(False))
        return self._table("rows").where(kept).join(hits.where(F.col("tier").isin(sorted(tiers))), "_row", "left_semi").drop("_row", "_tier", "_folder")

    def candidates(self, needle: str) -> DataFrame:
        """The indexed rows of which some text may contain the needle in any case: all that do are among them. None for an empty needle."""
        hits, counts = self._hits(needle)
        return self._rows(hits, sorted(counts))

    def best(self, needle: str, k: int, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``search`` of the needle's candidates, for a search that gives its k best rows, those of higher tiers first.

        The highest tiers with k candidates are searched first. They give the result if k of their rows are found, since
        rows of lower tiers come after those; else all candidates are searched.
        """
        hits, counts = self._hits(needle)
        in_tier = Counter()
        for (tier, _), n in counts.items():
            in_tier[tier] += n
        high, enough = [], 0
        for tier in sorted(in_tier, reverse=True):
            high.append(tier)
            enough += in_tier[tier]
            if enough >= k:
                break
        if enough >= k and len(high) < len(in_tier):
            found = fixed(search(self._rows(hits, sorted(x for x in counts if x[0] in high))), "gram-best")
            if found.count() >= k:
                return found
        return search(self._rows(hits, sorted(counts)))
