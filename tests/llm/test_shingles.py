"""Near-duplicates by shingle similarity against brute force, and the pipeline's stage that uses them."""

from __future__ import annotations

import random
from itertools import combinations

import corpus_pipeline
from pyspark.sql import functions as F

from glosswork.llm import shingles, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def word_sets(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def components(sets):
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        if similarity(sets[a], sets[b]) >= 0.8:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in range(len(sets))}


def edited_texts():
    rng = random.Random(31)
    texts = [None, "", " \t", "one two", "One  TWO", "a"]
    for group in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 100, 300]))]
        for k in range(6):
            copy = list(words)
            for at in rng.sample(range(len(copy)), k * len(copy) // 150):
                copy[at] = f"x{rng.randrange(3000)}"
            texts.append(" ".join(copy))
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)


def test_groups_are_those_of_all_pairs(spark):
    texts = edited_texts()
    want = components([word_sets(t) for t in texts])
    assert 20 < len(set(want.values())) < 60
    df = frame(spark, texts).withColumns({"key": F.lit("clash"), "id": F.lit(1)})
    df = df.union(df.where("doc_id = 3")).union(df.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long")))
    got = [(r["id"], r["component_id"]) for r in shingles.near_duplicate_groups(df).collect()]
    assert sorted(got, key=str) == sorted([*want.items(), (3, 3), (None, 3)], key=str)
    assert shingles.near_duplicate_groups(df.where("false")).count() == 0


def test_stage_drops_near_copies_of_similarity_point_eight(spark):
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(words), " ".join([*words[:50], "other", *words[51:]]), " ".join([*words[:90], *(f"y{i}" for i in range(60))])]
    kept = corpus_pipeline.without_near_duplicates(spark, frame(spark, texts), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 2]


def test_fingerprints_within_two_bits_meet_without_bands(spark, monkeypatch):
    monkeypatch.setattr(shingles, "band_hashes", lambda hashes, params: [])
    words = [f"w{i}" for i in range(1000)]
    texts = [*edited_texts(), *(" ".join([*words, last]) for last in "abcdef")]
    fps, sets = [simhash.simhash64(t) for t in texts], [word_sets(t) for t in texts]
    near = [(a, b) for a, b in combinations(range(len(texts)), 2) if (fps[a] ^ fps[b]).bit_count() <= 2 and similarity(sets[a], sets[b]) >= 0.8]
    group = {r["id"]: r["component_id"] for r in shingles.near_duplicate_groups(frame(spark, texts)).collect()}
    assert any(fps[a] != fps[b] for a, b in near) and any(fps[a] == fps[b] and sets[a] != sets[b] for a, b in near)
    assert all(group[a] == group[b] for a, b in near)


def test_prefix_pairs_lose_no_similar_pair(spark):
    rng = random.Random(37)
    base = [rng.sample(range(1000), rng.choice([5, 12, 40])) for _ in range(6)]
    sets = []
    for b in base:
        for k in range(8):
            out = set(rng.sample(b, rng.randrange(min(k, len(b) - 1) + 1)))
            sets.append(sorted({x for x in b if x not in out} | {2000 + rng.randrange(300) for _ in range(rng.randrange(3))}))
    table = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "key long, shingles array<long>")
    labels = {i: i // 3 for i in range(len(sets))}
    found = shingles._prefix_pairs(spark.createDataFrame(list(labels.items()), "key long, label long"), table, shingles.ShingleParams())
    got = {(r["a"], r["b"]) for r in found.collect()}
    want = {(a, b) for a, b in combinations(labels, 2) if labels[a] != labels[b] and similarity(set(sets[a]), set(sets[b])) >= 0.8}
    assert len(want) > 20 and want <= got and len(got) < 4 * len(want)


def test_large_group_of_copies_below_the_similarity_makes_few_pairs(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join([*words[:k], *(f"x{i}-{j}" for j in range(4)), *words[k + 4 :]]) for i in range(150) for k in [7 + i % 40]]
    sets = spark.createDataFrame([(i, [int(h) - (1 << 63) for h in shingles.shingle_hashes(t)]) for i, t in enumerate(texts)], "key long, shingles array<long>")
    labels = sets.select("key", F.col("key").alias("label"))
    assert shingles._prefix_pairs(labels, sets, shingles.ShingleParams()).count() < 150
