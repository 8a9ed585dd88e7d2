"""The registered queries, names and types included, against brute-force versions on hard rows and on empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from pyspark.sql import functions as F
from test_operators import LONG, TEXTS, base_spans, brute_fingerprint, same_components
from tokenizers import Tokenizer

from glosswork.llm import bpe, imatch, langid, pii, quality, queries, ranking

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
SCHEMAS = {
    "documents": DOCUMENTS,
    "labels": "doc_id long, quality int, toxic int",
    "pages": "page_id long, url string, html string",
    "embeddings": "vec_id long, embedding array<float>, label int",
}
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
VOCABULARY = "kamo lito ren sapu tobe vidu wex yori zanu quel brat fenn gosh hilt jarv".split()


def hard_documents():
    rng = random.Random(41)
    texts = [*TEXTS, "tail <|endoftext|> x", "!!! ???", "...", "%%", "a@b.cd +1 212 555 0123 10.0.0.1", "mail x@y.zz " * 400, "ha" * 2500]
    for i in range(60):
        words = [rng.choice(VOCABULARY) + str(rng.randrange(12)) for _ in range(rng.choice([3, 40, 200]))]
        texts += [" ".join(words), " ".join(words)] if i % 7 == 0 else [" ".join(words)]
    rows = [(i, t, ("en", "de", None)[i % 3], f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[20]]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rows = {
        "documents": hard_documents(),
        "labels": [(i, i % 2, 0) for i in range(50)],
        "pages": [(1, "u", "<p>a</p>"), (2, "u", None)],
        "embeddings": [(1, [1.0, 0.5], 0), (2, [1.0, 0.51], 0), (3, None, 0)],
    }
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows[name], schema).write.parquet(str(root / f"{name}.parquet"))
    return str(root)


@pytest.fixture(scope="module")
def docs():
    return hard_documents()


def fields(df):
    return {f.name: f.dataType.simpleString() for f in df.schema}


def rows_of(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


def test_no_query_fails_on_empty_tables(spark, tmp_path):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    for name, query in [*queries.QUERIES.items(), ("pipeline", corpus_pipeline.run)]:
        assert query(spark, str(tmp_path)).count() == 0, name


def test_op2_gives_the_librarys_ids(spark, folder, docs):
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    want = Counter()
    for i, t, *_ in docs:
        ids = encoding.encode_ordinary(t or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want[i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    df = queries.op2_byte_bpe(spark, folder)
    assert fields(df)["n_tokens"] == "bigint"
    assert rows_of(df, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_long_words_have_the_librarys_ids():
    engine = bpe.DuckBpe(RANKS)
    whole = tiktoken.Encoding("whole", pat_str="(?s).+", mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    rng = random.Random(43)
    letters = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    words = [letters("abcdefghijklmnopqrstuvwxyz", n) for n in (65, 900, 16_000, 1_000_000)]
    words += ["a" * 701, "ha" * 3000, "aab" * 500, "é" * 300 + "東京" * 500, letters("aab", 1500), letters("etaoin", 1500), "-" * 1001, "x"]
    found = engine.encode([w.encode() for w in words])
    w, tok = found["w"].to_numpy(), found["tok"].to_numpy()
    for k, word in enumerate(words):
        if len(word) < 20_000:
            assert tok[w == k].tolist() == whole.encode_ordinary(word), word[:20]
    assert engine.decode(found) == [x.encode() for x in words]


def test_op4_counts_base_kinds_and_scores_every_span(spark, folder, docs):
    df = queries.op4_pii(spark, folder)
    assert [fields(df)[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == ["bigint"] * 4
    got = sorted(df.collect(), key=lambda r: r["doc_id"])
    assert len(got) == len(docs)
    texts = {i: t or "" for i, t, *_ in docs}
    for r in got:
        base = base_spans(texts[r["doc_id"]])
        kinds = Counter(x.split(":")[0] for x in base.split(",") if x)
        assert {k: r[f"n_{k}"] for k in ("email", "ip", "card", "phone")} == {k: kinds[k] for k in ("email", "ip", "card", "phone")}
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        spans, scores = ([x for x in r[c].split(",") if x] for c in ("spans", "scores"))
        assert set(base.split(",")) - {""} <= set(spans) and len(spans) == len(scores)
        assert all(0 < float(s) <= 1 for s in scores)


def test_context_words_adjust_scores_across_many_spans(spark):
    texts = ["mail a@b.cd", "x a@b.cd", "mail " + "a@b.cd " * 2000, "mail " + "," * 50 + "a@b.cd", "é" * 30 + " mail e@f.gh"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(x["start"], x["score"]) for x in r["pii_spans"]] for r in pii.find_spans(df).collect()}
    assert [got[i] for i in (0, 1, 3, 4)] == [[(5, 1.0)], [(2, 0.8)], [(55, 0.8)], [(36, 1.0)]]
    assert [s for s, _ in got[2]] == [5 + 7 * k for k in range(2000)]
    near = lambda start: 1.0 if re.search(r"\bmail\b", texts[2][max(0, start - 40) : start]) else 0.8
    assert all(score == near(start) for start, score in got[2])
    cleaned = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert cleaned == {i: t.replace("a@b.cd", "<email>").replace("e@f.gh", "<email>") for i, t in enumerate(texts)}


def test_a_hundred_thousand_spans_in_one_text(spark):
    text = "naïve a@b.cd, " * 100_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.redact(df).first()["text"] == text.replace("a@b.cd", "<email>")


def spark_hash(terms):
    seed = 42
    for t in terms:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", t), seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def plain_terms(text):
    words = regex.findall(r"[\p{L}\p{N}]+", text.lower())
    return {h - (1 << 64) if h >= 1 << 63 else h for h in (xxhash.xxh64_intdigest(w, 42) for w in words)}


def plain_parts(text, band, p):
    terms = plain_terms(text)
    terms = sorted(terms & band or terms)
    parts = []
    for level in range(p.levels):
        for k in range(p.subsets):
            bits = lambda t: (t % (1 << 64)) >> (64 - 5 - level)  # noqa: B023, E731
            inside = [t for t in terms if bits(t) == k << level]
            parts.append(spark_hash(inside) % 65535 + 1 if inside else 0)
    return parts, not terms


def plain_likeness(a, b, p):
    if a == b:
        return 1.0
    value = 0.0
    for level in range(p.levels):
        x, y = (c[level * p.subsets : (level + 1) * p.subsets] for c in (a, b))
        full = sum(v != 0 for v in x + y)
        if full >= p.enough or (level == 0 and full):
            value = 2 * sum(u == v != 0 for u, v in zip(x, y, strict=True)) / full
    return value


def test_op5_against_plain_lexicon_parts_and_likeness(spark, folder, docs):
    p = imatch.IMatchParams(least_share=0.02, most_share=0.4)
    texts = {i: t or "" for i, t, *_ in docs}
    seen = Counter(t for _, text, *_ in docs for t in plain_terms(text or ""))
    band = {t for t, n in seen.items() if p.least_share * len(docs) <= n <= p.most_share * len(docs)}
    table = spark.read.parquet(f"{folder}/documents.parquet")
    slots = imatch.lexicon(table, p).first()["slots"]
    assert sorted(t for s in slots for t in s) == sorted(band) and 50 < len(band)
    following = {i: (i + 1) % len(texts) for i in texts}
    marked = imatch.fingerprint_with_edits(table, p)
    likeness = [imatch.likeness(F.col("parts"), F.col(c), p).alias(f"near_{c}") for c in ("edited_parts", "next_parts")]
    got = marked.select("*", imatch.fingerprint(F.col("parts")).alias("fingerprint"), *likeness).collect()
    assert len(got) == len(docs)
    for r in got:
        text, after = texts[r["id"]], texts[following[r["id"]]]
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        found = {"parts": text, "edited_parts": edited, "next_parts": after}
        for column, value in found.items():
            parts, bare = plain_parts(value, band, p)
            assert r[column][: p.levels * p.subsets] == parts and len(r[column]) == len(parts) + bare
        assert r["edited"] == edited
        assert r["fingerprint"] == " ".join(map(str, r["parts"]))
        assert abs(r["near_edited_parts"] - plain_likeness(r["parts"], r["edited_parts"], p)) < 1e-12
        assert abs(r["near_next_parts"] - plain_likeness(r["parts"], r["next_parts"], p)) < 1e-12
    bare = {r["text"]: r["fingerprint"] for r in got if r["text"] in ("...", "%%", "!!! ???")}
    assert len(set(bare.values())) == 3


def test_op5_recall_at_point_three(spark):
    df = queries.op5_imatch(spark, "/root/testdata/sf0.01")
    assert {c: fields(df)[c] for c in ("n_chars", "near_edited", "near_next", "fingerprint")} == {"n_chars": "bigint", "near_edited": "double", "near_next": "double", "fingerprint": "string"}
    share = lambda c: F.avg((F.col(c) >= 0.3).cast("int"))
    edited, other = df.agg(share("near_edited"), share("near_next")).first()
    assert edited > 0.94 and other < 0.01


def test_op7_links_all_pairs_within_two_bits(spark, folder, docs):
    prints = {i: brute_fingerprint(t) for i, t, *_ in docs}
    close = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    root = same_components(close, list(prints))
    want = Counter((i, f"{prints[i]:016x}", root[i]) for i, *_ in docs)
    assert rows_of(queries.op7_simhash(spark, folder), "doc_id", "fingerprint", "component_id") == want


def test_op8_law_of_rows(spark, folder, docs):
    df = queries.op8_sharding(spark, folder)
    assert {c: fields(df)[c] for c in ("size", "text_crc32", "shard", "slot", "grown_shard")} == {"size": "bigint", "text_crc32": "bigint", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    got = df.collect()
    plain = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len(plain(t)) + 8, zlib.crc32(plain(t))) for i, t, *_ in docs)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts[s] for s in range(24)) <= 1 and set(counts) <= set(range(24))
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in counts.items())
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}


def test_op10_pieces_have_the_plain_calls_ids(spark, folder, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = queries.op10_packing(spark, folder)
    assert {c: fields(df)[c] for c in ("piece", "start", "length", "ids_crc32", "sequence_id", "offset")} == {"piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    want, sequences = Counter(), {}
    for i, t, *_ in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        ends = list(range(len(ids), 0, -1024))[::-1]
        for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            want[i, k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))] += 1
    assert rows_of(df, "doc_id", "piece", "start", "length", "ids_crc32") == want
    for r in df.collect():
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in sequences.values():
        ends = np.cumsum([n for _, n in sorted(placed)]).tolist()
        assert [a for a, _ in sorted(placed)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_counts_that_are_broadcast_do_not_grow_with_partitions_times_groups(spark, monkeypatch):
    broadcast = []
    real = F.broadcast
    monkeypatch.setattr(ranking.F, "broadcast", lambda df: broadcast.append(df) or real(df))
    df = spark.range(6000).select((F.col("id") % 300).alias("g"), "id")
    sizes = {}
    for parts in (8, 128):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        try:
            ranking.ranked(df.repartition(parts), ["g"], [F.col("id").asc()], "t")
            sizes[parts] = broadcast[-1].count()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        seen = len(broadcast)
        found = ranking.numbered(df.repartition(parts), ["g"], "t")
        assert len(broadcast) == seen  # Spark decides by the written size
        assert found.groupBy("g").agg(F.count_distinct("rank").alias("n"), F.max("rank").alias("m")).where("n <> 20 or m <> 19").count() == 0
    assert sizes[8] <= 308 and sizes[128] <= 428


# --- 1 and 6: plain versions of the models


def plain_grams(text, buckets):
    mask = (1 << 32) - 1
    words = [zlib.crc32(w.encode()) for w in quality.TOKEN.findall(text.lower())]
    grams = [((h * 0x9E3779B1 & mask) >> 7) % buckets for h in words]
    for a, b in zip(words, words[1:], strict=False):
        mixed = ((a * 0x85EBCA6B & mask) ^ (b * 0xC2B2AE35 & mask)) * 0x27D4EB2F & mask
        grams.append((mixed >> 5) % buckets)
    for gap in (1, 2):
        grams += [gap - 1] * sum(a == b for a, b in zip(words, words[gap:], strict=False))
    return Counter(grams)


def plain_ftrl(examples, p):
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= p.l1:
            return 0.0
        return -(z[i] - (p.l1 if z[i] > 0 else -p.l1)) / ((p.beta + n[i] ** 0.5) / p.alpha + p.l2)

    rng = np.random.default_rng(p.seed)
    for _ in range(p.epochs):
        for k in rng.permutation(len(examples)):
            x, y = examples[k]
            w = {i: weight(i) for i in x}
            guess = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = (guess - y) * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / p.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_quality_training_and_scores_against_plain_loops(spark):
    rng = random.Random(47)
    texts = [" ".join(rng.choices(VOCABULARY[: 8 if i % 2 else 15], k=rng.randrange(1, 30))) + "!" * (i % 3) for i in range(80)] + ["", "so so so, a b a b"]
    p = quality.QualityParams(buckets=4096, epochs=2)
    docs = spark.createDataFrame(list(enumerate([*texts, None])), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], SCHEMAS["labels"])
    model = quality.train(docs, labels, p)
    order = [r["doc_id"] for r in labels.select("doc_id", F.xxhash64(F.lit(p.seed), "doc_id").alias("h")).orderBy("h").collect()]

    def features(text):
        grams = plain_grams(text, p.buckets)
        total = max(1, sum(grams.values()))
        return {i: float(np.float32(quality.SCALE * c / total)) for i, c in grams.items()}

    want = plain_ftrl([({**features(texts[i]), "bias": 1.0}, i % 2) for i in order], p)
    assert abs(want.pop("bias") - model.bias) < 1e-6
    assert all(abs(model.weights[i] - w) < 1e-6 for i, w in want.items())
    assert not set(np.flatnonzero(model.weights)) - set(want)
    for r in quality.score(docs, model).collect():
        dot = sum(v * model.weights[i] for i, v in features(r["text"] or "").items()) + model.bias
        assert abs(r["quality_score"] - 1 / (1 + np.exp(-dot))) < 1e-6


def plain_subwords(text, buckets):
    mask = (1 << 32) - 1
    grams = Counter()
    words = langid.NOT_LETTERS.sub(" ", text.lower()).split()
    for word in words:
        codes = [32, *map(ord, word), 32]
        for size in (2, 3, 4):
            for at in range(len(codes) - size + 1):
                run = codes[at : at + size]
                rolled = run[0] * 0x9E3779B1 & mask
                for c in run[1:]:
                    rolled = ((rolled ^ (rolled >> 15)) * 0x85EBCA6B + c * 0x9E3779B1) & mask
                rolled = (rolled ^ (rolled >> 13)) * 0xC2B2AE35 & mask
                grams[(rolled ^ (rolled >> 16)) % buckets] += 1
    return grams


def plain_sgd(texts, langs, p):
    rng = np.random.default_rng(p.seed)
    names = sorted(set(langs))
    embed = rng.normal(0, 0.05, (p.buckets, p.dims)).astype(np.float32)
    weights = rng.normal(0, 0.05, (p.dims, len(names))).astype(np.float32)
    bias, seen, examples = np.zeros(len(names), np.float32), set(), []
    held = rng.random(len(texts)) < p.calibration_share
    for text, lang, out in zip(texts, langs, held, strict=True):
        words = text.split()
        if out or not words:
            continue
        start = int(rng.integers(len(words)))
        for piece in (text, " ".join(words[start : start + int(rng.integers(1, 25))])):
            grams = plain_subwords(piece, p.buckets)
            if grams:
                seen |= set(grams)
                examples.append((grams, names.index(lang)))
    at, steps = 0, p.epochs * len(examples)
    for _ in range(p.epochs):
        for k in rng.permutation(len(examples)):
            grams, y = examples[k]
            total = sum(grams.values())
            rate = p.rate * (1 - at / steps)
            at += 1
            hidden = sum(np.float32(c / total) * embed[g] for g, c in grams.items())
            logits = hidden @ weights + bias
            error = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
            error[y] -= 1
            back = weights @ error
            weights -= rate * np.outer(hidden, error)
            bias -= rate * 0.01 * error
            for g, c in grams.items():
                embed[g] -= (rate * 20) * np.float32(c / total) * back
    embed[[i for i in range(p.buckets) if i not in seen]] = 0
    return embed @ weights, bias


def test_language_training_and_scores_against_plain_loops(spark):
    rng = random.Random(53)
    syllables = {"xx": ["ka", "ko", "mi"], "yy": ["schl", "ung", "pf"]}
    langs = ["xx", "yy"] * 20
    texts = [" ".join("".join(rng.choices(syllables[x], k=3)) for _ in range(rng.randrange(1, 20))) for x in langs]
    p = langid.LangIdParams(buckets=2048, dims=6, epochs=2)
    model = langid._fit(texts, langs, p)
    table, bias = plain_sgd(texts, langs, p)
    assert np.abs(model.table - table).max() < 1e-3 and np.abs(model.bias - bias).max() < 1e-4
    probes = [*texts, "kamika Schlung 12", "x", ""]
    df = spark.createDataFrame(list(enumerate(probes)), "doc_id long, text string")
    for r in langid.predict(df, model).collect():
        grams = plain_subwords(r["text"], p.buckets)
        if not grams:
            assert (r["lang_pred"], r["lang_score"]) == ("und", 0)
            continue
        logits = sum(c * model.table[g] for g, c in grams.items()) / sum(grams.values()) + model.bias
        sure = np.exp((logits - logits.max()) / model.temperature)
        sure /= sure.sum()
        assert r["lang_pred"] == model.languages[int(sure.argmax())]
        assert abs(r["lang_score"] - sure.max()) < 1e-9 and r["lang_accepted"] == (r["lang_score"] >= model.threshold)


def test_op1_and_op6_rows(spark, folder, docs):
    rest = lambda i, m: zlib.crc32(str(i).encode()) % m
    one, six = queries.op1_quality(spark, folder), queries.op6_language(spark, folder)
    assert {c: fields(one)[c] for c in ("held_out", "score", "predicted")} == {"held_out": "boolean", "score": "double", "predicted": "int"}
    assert {c: fields(six)[c] for c in ("held_out", "lang_pred", "score")} == {"held_out": "boolean", "lang_pred": "string", "score": "double"}
    assert rows_of(one, "doc_id", "held_out") == Counter((i, rest(i, 5) == 0) for i, *_ in docs)
    assert rows_of(six, "doc_id", "held_out") == Counter((i, rest(i, 4) == 2) for i, *_ in docs)
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in one.collect())
    blank = {i for i, t, *_ in docs if not re.search(r"[^\W\d_]", t or "")}
    assert {r["doc_id"] for r in six.where("lang_pred = 'und'").collect()} == blank and LONG in {t for _, t, *_ in docs}


PERIODIC = ["aab" * 20_000, "thecatsat" * 1500, "itualinctions" * 90, "ab" * 4000, "tion" * 900, "a" * 5000, "olltit" * 300]


def test_periodic_words_give_the_librarys_ids_in_few_rounds():
    engine, library = bpe.engine(RANKS), tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    began = time.time()
    for word in PERIODIC:
        assert engine.encode([word.encode()])["tok"].to_pylist() == library.encode(word), word[:20]
    assert time.time() - began < 30


def test_long_words_of_few_letters_merge_in_the_order_of_ranks():
    rng, ranks = random.Random(4), bpe.read_ranks(RANKS)
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(66, 140))).encode() for letters in ("otli", "ab", "estr", "nio ") for _ in range(60)]

    def plainly(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                return [ranks[x] for x in parts]
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rows = bpe.engine(RANKS).encode(words)
    got = {}
    for w, tok in zip(rows["w"].to_pylist(), rows["tok"].to_pylist(), strict=True):
        got.setdefault(w, []).append(tok)
    assert [got[w] for w in range(len(words))] == [plainly(x) for x in words]
