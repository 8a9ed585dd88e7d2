"""Spelling variants, collocations and exact top-k against brute-force versions on hard rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosswork.llm import phrases, spelling, topk

LOWER = str.maketrans(spelling.UPPER, spelling.LOWER)
DOCS = "doc_id long, text string, lang string, word string, id long, f long, n long, run string, h long"  # with names that the operators use


def spelled_documents():
    rng = random.Random(5)
    base = ["Banana" + "na" * k for k in range(6)] + ["letteRRR", "zebraÀÿst", "xylophon", "éèêëÉÈabc", "aaaaaaaaa", "commitee"]
    texts = [None, "", "  \n", "short", "a" * 3000 + " " + "a" * 3000, "a" * 2999, "b" * 40]
    for _ in range(400):
        words = []
        for _ in range(rng.randrange(1, 40)):
            w = list(rng.choice(base[: 1 + rng.randrange(len(base))]))
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = [] if rng.random() < 0.4 else [rng.choice("abnÀz")]
            words.append("".join(w))
        texts.append(rng.choice([" ", "-", "1", "_"]).join(words))
    rows = [(i, t) for i, t in enumerate(texts)]
    return [*rows, rows[9], rows[9], (None, texts[12]), (None, texts[13])]


def brute_words(docs, least=7, times=2):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= times}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(words):
    out, form = set(), {}
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


@pytest.mark.parametrize("partitions", ["1", "4", "13"])
def test_spelling_variants_are_those_of_all_pairs(spark, partitions):
    docs = spelled_documents()
    rows = [(i, t, "x", "w", 1, 2, 3, "r", 4) for i, t in docs]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = spelling.spelling_variants(spark.createDataFrame(rows, DOCS)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = brute_variants(brute_words(docs))
    assert len(got) == len(want) and set(map(tuple, got)) == want
    assert any(r.root != r.form and r.form for r in got) or len({r.form for r in got}) > 3


def test_trie_nodes_are_equal_where_prefixes_are(spark):
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(12))) for _ in range(600)})
    df = spark.createDataFrame([(w,) for w in words], "word string").repartition(7)
    nodes = {}
    for w, numbers in spelling.with_trie_nodes(df, F.col("word"), "nodes", "test-trie").collect():
        assert len(numbers) == len(w) + 1
        for i, x in enumerate(numbers):
            assert nodes.setdefault(w[:i], x) == x
    assert len(set(nodes.values())) == len(nodes)


def phrase_documents():
    rng = random.Random(8)
    texts = [None, "", " \t", ".,;", "of the " * 90, "x" * 5000, "New york city hall x. " * 45, "\U0001f600 \U0001f600 b" * 40, "\x00a b\x00" * 35]
    common = ["The", "of", "and", "in", "to"]
    for _ in range(220):
        words = [rng.choice(common) if rng.random() < 0.5 else rng.choice("red tin box sits here now ok".split()) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["New York", "machine Learning model", "a.b", "x,\ny", "in the red tin"]))
        texts.append(rng.choice([" ", "\t", "  "]).join(words))
    rows = [(t, ("en", None, "und", "de")[i % 4]) for i, t in enumerate(texts)]
    return [*rows, rows[20], rows[20]]


def brute_phrases(docs, p):
    f = defaultdict(Counter)
    for text, lang in docs:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            for n in range(1, p.longest + 1):
                f[lang or "und"].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    share, whole = p.containment
    for lang, counts in f.items():
        total = sum(a for w, a in counts.items() if len(w) == 1)
        good = {w: a for w, a in counts.items() if len(w) > 1 and a >= p.least_count}
        held = set()
        for w, a in good.items():
            for i in range(len(w)):
                for j in range(i + 2, len(w) + 1):
                    if j - i < len(w) and whole * a >= share * good[w[i:j]]:
                        held.add(w[i:j])
        rows = []
        for w, a in good.items():
            cuts = [(p.scale * a // (counts[w[:k]] + counts[w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            if w not in held:
                rows.append((-score, -a, " ".join(w).encode(), counts[w[:k]], counts[w[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[: p.top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total, -score))
    return Counter(out)


@pytest.mark.parametrize(
    "params",
    [
        phrases.PhraseParams(),
        phrases.PhraseParams(top=5, widening=2),  # several rounds
        phrases.PhraseParams(least_count=8, top=3, widening=2, filter_bits=8),  # filters that are nearly full
        phrases.PhraseParams(least_count=4, top=40, widening=2, filter_bits=12, longest=5),
    ],
)
def test_phrases_are_those_of_all_counts(spark, params):
    docs = phrase_documents()
    rows = [(i, t, lang, "w", 1, 2, 3, "r", 4) for i, (t, lang) in enumerate(docs)]
    got = phrases.top_phrases(spark.createDataFrame(rows, DOCS).repartition(3), params).collect()
    assert Counter(map(tuple, got)) == brute_phrases(docs, params)


def test_ratios_are_exact_beyond_64_bits(spark):
    df = spark.createDataFrame([(9_223_372_036_854_775_807, 9_223_372_036_854_775_806)], "a long, b long")
    got = df.select(phrases._ratio("a", "b + cast(1 as decimal(20,0)) + a", phrases.PhraseParams())).first()[0]
    assert got == 2_000_000 * (2**63 - 1) // (2 * (2**63 - 1))


def brute_top(rows, k):
    usable = [(i, v, [floor(256 * x) for x in e]) for i, (v, e) in enumerate(rows) if e is not None and all(x is not None and isfinite(256 * x) for x in e)]
    out = Counter()
    for i, v, e in usable:
        if v is None or v % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(e, o, strict=True)), w is None, w or 0, w) for j, w, o in usable if j != i and len(o) == len(e)]
        out.update((v, r, w, -s) for r, (s, _, _, w) in enumerate(sorted(scored, key=lambda t: t[:3])[:k], 1))
    return out


@pytest.mark.parametrize("block", [7, 64, 8192])
def test_top_k_is_that_of_all_products(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((600, 24)) / 5)]
    rows += [(1000 + i, rows[50][1]) for i in range(200)]  # one common vector, ties
    rows += [(50, rows[50][1]), (100, rows[7][1]), (None, rows[0][1]), (None, [0.5] * 24), (2000, None), (2050, [0.1, None]), (2100, [float("nan")] * 24)]
    rows += [(2150, [float("inf")] + [0.0] * 23), (2200, []), (2201, []), (2250, [1e9, -3.0]), (2251, [1e5, 1e8]), (2252, [-1e5, 5.0]), (2300, [0.0] * 24), (2350, [-0.001] * 24)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<double>, row long, dims int, id string")
    params = topk.ListParams(candidates_per_block=block, queries_per_block=max(3, block // 4), queries_at_once=5, finalists=8)
    got = topk.top_inner_products(df, F.col("vec_id") % 50 == 0, 5, params).collect()
    assert Counter(map(tuple, got)) == brute_top(rows, 5)


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(3)
    vectors = np.floor(rng.standard_normal((4000, 16)) * 40)
    vectors = np.vstack([vectors, vectors[5] + rng.integers(-2, 3, (10, 16))])
    lists = topk.SortedLists(vectors)
    queries = vectors[[5, 7, 4003]]
    scores = queries @ vectors.T
    for depth in (1, 500, 3000, len(vectors)):
        lower, upper = lists.bounds(queries, depth)
        assert (lower <= scores).all() and (scores <= upper).all()
    assert (lower == upper).all()
    left = lists.finalists(queries, 5, topk.ListParams(finalists=64, depths=(0.3, 1.0)))
    for found, row in zip(left, scores, strict=True):
        assert set(np.argsort(-row)[:5]) <= set(found.tolist()) and len(found) < 400
