"""Groups of spelling variants: words one edit apart, found through numbered nodes of two tries."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, log2, log10

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from glosswork.llm.storage import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = "A-Za-zÀ-ÿ"
_LOCAL_BITS = 40


def corpus_words(docs: DataFrame, least_length: int = 7, least_count: int = 2, one_in: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the letter runs of all texts, A-Z lower-cased, some with a letter left out, that occur often enough.

    A run whose crc32 of ``<id>:<run>`` is divisible by ``one_in`` loses its letter at crc32 % length. Runs that are
    shorter than ``least_length`` before or after that are no words. A null text has no runs; a null id is written as
    nothing. Repeated rows count each.
    """
    runs = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"([{LETTERS}]{{{least_length},}})"), 1)
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    found = found.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    hashed = found.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _shared(a: str, b: str) -> int:
    """How many first letters two words have in common."""
    for i, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            return i
    return min(len(a), len(b))


def with_trie_nodes(words: DataFrame, key: Column, into: str, name: str) -> DataFrame:
    """Add ``into``: the numbers of the trie nodes that the word's ``key`` passes, the root first.

    Equal prefixes have equal numbers and different ones different numbers. The words are dealt and sorted by range of
    the key, so a node's words are neighbours and each task numbers the nodes of its own range. A prefix that reaches
    from one range into the next has the number of the range where it begins; these numbers are settled from the first
    and last word of every range, a row a range, and joined to the ranges that follow. Keys must be distinct.
    """
    spark = words.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = words.withColumn("_key", key).repartitionByRange(parts, "_key").sortWithinPartitions("_key")
    at = len(words.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        following, before, nodes = part << _LOCAL_BITS, "", []
        for batch in batches:
            lists = []
            for word in batch.column(at).to_pylist():
                same = _shared(before, word) + 1 if nodes else 0
                fresh = len(word) + 1 - same
                nodes = [*nodes[:same], *range(following, following + fresh)]
                following += fresh
                before = word
                lists.append(nodes)
            columns = [*batch.columns, pa.array(lists, pa.list_(pa.int64())), pa.array([part] * batch.num_rows, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_nodes", "_part"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema)
    local = materialise(keyed.mapInArrow(run, f"{kept}, _nodes array<long>, _part int"), name)
    ends = local.groupBy("_part").agg(F.min("_key"), F.max("_key"), F.max_by("_nodes", "_key")).collect()
    carried, last_key, last_nodes = [], None, []
    for part, first, last, nodes in sorted(ends):
        carry = last_nodes[: _shared(last_key, first) + 1] if last_key is not None else []
        carried.append((part, carry))
        base = part << _LOCAL_BITS
        last_key, last_nodes = last, [carry[x - base] if x - base < len(carry) else x for x in nodes]
    settled = spark.createDataFrame(carried, "_part int, _carry array<long>")
    base = F.shiftleft(F.col("_part").cast("long"), _LOCAL_BITS)
    # a range's first word opens its first nodes, so their numbers are places in what the range before hands on
    places = F.transform("_nodes", lambda x: F.coalesce(F.get("_carry", (x - base).cast("int")), x))
    joined = local.join(F.broadcast(settled), "_part")
    return joined.select(*words.columns, places.alias(into))


def one_edit_links(words: DataFrame) -> DataFrame:
    """(a, b): each two ids of words (id, n, word) that differ by exactly one letter put in, left out or replaced, in both directions.

    A word is the node pair (prefix before i, suffix after i) for each letter i that it may skip, and (prefix, suffix)
    for each place where a letter may be put in. Words that meet in a pair of skips differ in one letter; a skip meets
    a place between letters when the longer word has one letter more. Of equal neighbouring letters only the first
    counts as the one left out, so each two words meet once. As a pair fixes all letters but one, no pair has more
    words than there are letters. The nearest word's ``n`` comes along as ``n_b``.
    """
    numbered = with_trie_nodes(words, F.col("word"), "forward", "trie-prefixes")
    numbered = with_trie_nodes(numbered, F.reverse("word"), "backward", "trie-suffixes")
    length, letters = F.length("word"), F.regexp_extract_all("word", F.lit("(?s)(.)"), 1)
    suffixes = F.reverse("backward")  # at i: the suffix from i on
    before = F.concat(F.array(F.lit("")), F.slice(letters, F.lit(1), length - 1))
    skips = F.arrays_zip(
        F.slice("forward", F.lit(1), length).alias("p"), F.slice(suffixes, F.lit(2), length).alias("s"), letters.alias("c"), before.alias("c0")
    )
    places = F.arrays_zip(F.col("forward").alias("p"), suffixes.alias("s"))
    skipped = numbered.select("id", "n", F.explode(skips).alias("x")).select("x.p", "x.s", F.when(F.col("x.c") == F.col("x.c0"), 0).otherwise(1).alias("kind"), "id", "n")
    put_in = numbered.select("id", "n", F.explode(places).alias("x")).select("x.p", "x.s", F.lit(2).alias("kind"), "id", "n")
    pairs = materialise(skipped.union(put_in), "trie-pairs")
    other = pairs.select("p", "s", F.col("kind").alias("kind_b"), F.col("id").alias("b"), F.col("n").alias("n_b"))
    replaced = (F.col("kind") < 2) & (F.col("kind_b") < 2)
    left_out = ((F.col("kind") == 1) & (F.col("kind_b") == 2)) | ((F.col("kind") == 2) & (F.col("kind_b") == 1))
    joined = pairs.withColumnRenamed("id", "a").join(other, ["p", "s"]).where((F.col("a") != F.col("b")) & (replaced | left_out))
    return joined.select("a", "b", "n_b")


def variant_forms(words: DataFrame, factor: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for distinct words (word, n).

    A word's form is its near word of the largest n, ties to the smallest in code-point order, if that n is at least
    ``factor`` times the word's own. ``root`` follows forms to the last word. An n of a form is a factor larger, so a
    chain is as long as n has digits at most, and a few doublings of the steps reach every root.
    """
    words = words.select("word", F.col("n").cast("long").alias("n"))
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = words.repartitionByRange(parts, "word").sortWithinPartitions("word")
    words = materialise(in_order.withColumn("id", F.monotonically_increasing_id()), "spelling-words")  # ids in code-point order
    near = one_edit_links(words).groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.max(F.struct(F.col("n_b"), (-F.col("b")).alias("minus_b"))).alias("best"))
    linked = words.join(near, words.id == near.a, "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "best")
    formed = F.col("best.n_b") >= F.col("n") * factor
    linked = materialise(linked.select("id", "word", "n", "n_near", F.when(formed, -F.col("best.minus_b")).alias("form_id")), "spelling-links")
    steps = linked.where("form_id is not null").select(F.col("id").alias("node"), F.col("form_id").alias("root_id"))
    most = words.agg(F.max("n")).first()[0] or 1
    longest = max(1, floor(log10(max(most, 1)) / log10(factor)) + 1)
    for _ in range(ceil(log2(longest))):
        ahead = steps.select(F.col("node").alias("via"), F.col("root_id").alias("next_id"))
        steps = steps.join(ahead, steps.root_id == ahead.via, "left").select("node", F.coalesce("next_id", "root_id").alias("root_id"))
        steps = materialise(steps, "spelling-roots")
    names = words.select(F.col("id").alias("k"), F.col("word").alias("name"), F.col("n").alias("name_n"))
    forms = names.select(F.col("k").alias("form_id"), F.col("name").alias("form"), F.col("name_n").alias("form_n"))
    roots = steps.join(names, steps.root_id == names.k).select("node", F.col("name").alias("root"))
    found = linked.join(forms, "form_id", "left").join(roots, F.col("id") == F.col("node"), "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The words of all texts with their forms and roots; see ``corpus_words`` and ``variant_forms``. Other columns are not read."""
    return variant_forms(corpus_words(docs, id_col=id_col, text_col=text_col))
