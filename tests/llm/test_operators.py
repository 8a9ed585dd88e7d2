"""Each operator against a brute-force version, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import random
import re
import zlib
from collections import Counter
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glosswork.llm import bpe, components, imatch, langid, packing, pii, pretokens, quality, queries, ranking, sharding, simhash, vectors, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{i % 977} tail" for i in range(30_000))
TEXTS = [None, "", " \t\n", "a", "one two", "Straße, naïve œuvre 東京 🙂🙂", "x\x1cy\x85z\xa0w", "same words here again", "Same WORDS here again", "same words here again", LONG, LONG + " more"]


def documents(spark, texts=TEXTS, **columns):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns(columns) if columns else df


def same_components(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


# --- shared helpers


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (0, 1), (1, 0)]
    random.Random(3).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["label"] for r in components.connected_components(df).collect()}
    want = same_components(edges, {x for e in edges for x in e})
    assert got == want
    assert components.connected_components(df.where("false")).count() == 0


def test_ranks_and_numbers(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab") if i % 3 else "hot", rng.randrange(50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    ranked = ranking.ranked(df, ["g"], [F.col("v").asc()], "t").collect()
    numbered = ranking.numbered(df, ["g"], "t").collect()
    for found in (ranked, numbered):
        for g in ("a", "b", "hot"):
            assert sorted(r["rank"] for r in found if r["g"] == g) == list(range(sum(x[0] == g for x in rows)))
    for g in ("a", "b", "hot"):
        values = [r["v"] for r in sorted(ranked, key=lambda r: r["rank"]) if r["g"] == g]
        assert values == sorted(values)
    everything = ranking.ranked(df, [], [F.col("i").asc()], "t").collect()
    assert all(r["rank"] == r["i"] for r in everything)
    assert ranking.ranked(df.where("false"), ["g"], [F.col("v").asc()], "t").count() == 0


# --- 7: SimHash


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles)) if shingles else 0


def test_simhash_fingerprints_and_groups(spark):
    df = documents(spark, fp=F.lit("clash"), id=F.lit(1), component_id=F.lit(2))
    df = df.union(df.where("doc_id = 7")).union(df.where("doc_id = 7").withColumn("doc_id", F.lit(None).cast("long")))
    got = simhash.near_duplicate_groups(df).collect()
    assert len(got) == len(TEXTS) + 2
    of = {r["id"]: r for r in got if r["id"] is not None}
    for i, t in enumerate(TEXTS):
        assert of[i]["fp"] % (1 << 64) == brute_fingerprint(t)
    assert {of[i]["component_id"] for i in (0, 1, 2)} == {0}
    assert {of[i]["component_id"] for i in (7, 8, 9)} == {7}
    assert simhash.near_duplicate_groups(df.where("false")).count() == 0


def test_ball_hashing_finds_every_close_pair(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1}
    for f in list(fps):
        for _ in range(6):
            g = f
            for _ in range(rng.randrange(1, 5)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    edges = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    got = {r["node"]: r["label"] for r in components.connected_components(edges).collect()}
    close = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    want = same_components(close, signed)
    assert {k: got.get(k, k) for k in signed} == want


# --- 6 and 1: the classifiers


def test_language_model_learns_and_rejects(spark):
    rng = random.Random(7)
    syllables = {"xx": ["ka", "ko", "mi"], "yy": ["schl", "ung", "pf"]}
    rows = [(i, " ".join("".join(rng.choices(syllables[x], k=3)) for _ in range(rng.randrange(1, 60))), x) for i, x in enumerate(["xx", "yy"] * 150)]
    docs = spark.createDataFrame(rows + [(900, None, "xx"), (901, "kami", None)], "doc_id long, text string, lang string")
    model = langid.train(docs, F.col("doc_id") % 4 != 2)
    assert model.languages == ("xx", "yy")
    extra = spark.createDataFrame([(1000, None, None), (1001, "", None), (1002, "123 !!", None), (1003, "東京都", None), (1004, "KAMIKO " * 40_000, None)], docs.schema)
    found = langid.predict(docs.union(extra).withColumn("lang_pred", F.lit("clash")), model)
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == 307
    held = [i for i, *_ in rows if i % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.97
    assert np.mean([got[i]["lang_accepted"] for i in held]) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["lang_score"] == 0 and not got[i]["lang_accepted"] for i in (900, 1000, 1001, 1002))
    assert got[1004]["lang_pred"] == "xx"
    assert got[1003]["lang_pred"] in model.languages
    assert langid.predict(docs.where("false"), model).count() == 0
    unknowing = langid.train(docs.where("false"), F.lit(True))
    assert unknowing.languages == ()
    blank = langid.predict(docs, unknowing).collect()
    assert len(blank) == 302 and all((r["lang_pred"], r["lang_score"], r["lang_accepted"]) == ("und", 0, False) for r in blank)
    many = docs.sparkSession.range(5).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.col("id").cast("string").alias("lang"))
    assert langid.train(many, F.lit(True)).languages == tuple("01234")
    with pytest.raises(ValueError):
        langid.train(many, F.lit(True), langid.LangIdParams(most_languages=4))


def test_quality_model_learns_from_good_labels(spark):
    rng = random.Random(9)
    good = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40)) + "."
    bad = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)).upper() + "!!" for _ in range(40))
    rows = [(i, good() if i % 3 else bad()) for i in range(400)]
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (1002, bad() * 3000)], "doc_id long, text string").withColumn("quality_score", F.lit(7))
    labels = [(i, int(i % 3 > 0)) for i, _ in rows if i % 5] + [(1, 1), (1, None), (2, 0), (3, 5), (None, 1)]
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = {r["doc_id"]: r["quality_score"] for r in quality.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    held = [i for i, _ in rows if i % 5 == 0]
    assert np.mean([(got[i] >= 0.3) == (i % 3 > 0) for i in held]) > 0.95
    assert got[1000] == got[1001]
    assert got[1002] < 0.3
    blank = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["quality_score"] for r in quality.score(docs, blank).collect()} == {0.5}
    assert quality.score(docs.where("false"), model).count() == 0


def test_classifiers_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = queries.op6_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    good = queries.op1_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert good.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.9


# --- 2 and 10: tokens


@pytest.fixture(scope="module")
def reference_encoder():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_words_split_as_the_pattern_does(reference_encoder):
    rng = random.Random(11)
    for _ in range(2000):
        text = "".join(chr(rng.choice([rng.randrange(256), rng.randrange(64), 32, 10, 39, rng.randrange(97, 123), rng.choice([0x17F, 0x5D0, 0x1F642, 0x3000])])) for _ in range(25))
        pieces = pretokens.split_words(text)
        assert [t for w in pieces for t in reference_encoder.encode_ordinary(w)] == reference_encoder.encode_ordinary(text)


def test_bpe_encodes_and_decodes(spark, reference_encoder):
    texts = [*TEXTS, "a" * 700, "zq" * 300, "<|endoftext|> x"]
    df = documents(spark, texts, id=F.lit("clash"), ids=F.lit(1))
    encoded = bpe.encode_documents(df.union(df.where("doc_id = 5")), RANKS)
    rows = encoded.collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        want = reference_encoder.encode_ordinary(texts[r["id"]] or "")
        assert r["ids"] == want
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["id"]] or "").encode()).hexdigest()
    decoded = {r["id"]: bytes(r["decoded"]) for r in bpe.decode_documents(encoded, RANKS).collect()}
    assert decoded == {i: (t or "").encode() for i, t in enumerate(texts)}
    assert bpe.encode_documents(df.where("false"), RANKS).count() == 0


def test_packing_of_documents(spark):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    texts = [*TEXTS * 4, "tail <|endoftext|> x", "<|endoftext|>", "<|endoftext|><|endoftext|>é " * 700]
    df = documents(spark, texts, length=F.lit("clash"), piece=F.lit(0))
    rows = packing.pack(packing.token_pieces(df, TOKENIZER)).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for k, p in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            assert (p["piece"], p["start"]) == (k, at)
            assert k == 0 or p["length"] == 1024
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(packing.token_pieces(df.where("false"), TOKENIZER)).count() == 0


def test_plans_use_every_piece_once():
    rng = random.Random(13)
    for capacity in (1, 7, 64, 1024):
        for size in (0, 1, 50, 3000):
            counts = Counter(rng.randrange(1, capacity + 1) for _ in range(size))
            made = packing.plan(counts, capacity)
            used = Counter()
            for lengths, times in made:
                assert sum(lengths) <= capacity and times > 0
                for x in lengths:
                    used[x] += times
            assert used == counts
    exact = packing.plan({1000: 5, 24: 5, 600: 3, 400: 3, 12: 6}, 1024)
    assert sum(t for _, t in exact) == 8
    assert sum(t for _, t in packing.plan({256: 40, 300: 6, 400: 3, 24: 3})) == 13  # complements of lengths below half


# --- 3: WARC


def test_warc_round_trip(spark):
    pages = [(3, "http://a/1", "<p>é</p>"), (1, "http://a/2", "<p>é</p>"), (2, None, ""), (4, "u\r\nx", None), (5, "http://b", "x" * 3_000_000), (None, "http://c", "<p>é</p>"), (6, "http://d", "<p>é</p>"), (6, "http://d", "<p>é</p>")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    folder = queries.new_folder(spark, "warc-test")
    index = warc.archive(df, folder, archive_bytes=1000)
    got = warc.read_indexed(index, folder).collect()
    assert len(got) == len(pages)
    least = {}
    for i, _, h in pages:
        if i is not None:
            least[h or ""] = min(least.get(h or "", i), i)
    found = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    want = Counter()
    for i, _, h in pages:
        data = (h or "").encode()
        revisit = i is not None and least[h or ""] < i
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", least[h or ""] if revisit else None] += 1
    assert found == want
    root = Path(urlparse(folder).path)
    for archive in (root / "records").glob("*.warc.gz"):
        side = [json.loads(x) for x in Path(str(archive).removesuffix(".warc.gz") + ".index.jsonl").read_text().splitlines()]
        data = archive.read_bytes()
        assert b"".join(gzip.decompress(data[r["offset"] : r["offset"] + r["length"]]) for r in side) == gzip.decompress(data)
        assert all(gzip.decompress(data[r["offset"] : r["offset"] + r["length"]]).startswith(b"WARC/1.1\r\n") for r in side)
    empty = queries.new_folder(spark, "warc-empty")
    assert warc.read_indexed(warc.archive(df.where("false"), empty), empty).count() == 0


# --- 4: personal data


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(found))


def test_personal_data_is_found_where_the_patterns_say(spark):
    rng = random.Random(17)
    alphabet = "1234567890..--@@ab_+ () é🙂x,AZ"
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(120))) for _ in range(1500)]
    texts += [None, "", "a@b.c@d.e_x@y.z 1.2.3.4.5.6.7.8", "0001.2.3.255 256.1.1.1", "4539578763621486 4539 5787 6362 1486", "a.b@c.de " * 3000]
    df = documents(spark, texts, pii_spans=F.lit("clash"))
    spans = F.col("pii_spans")
    for r in pii.find_spans(df).select("doc_id", pii.joined_spans(F.filter(spans, lambda x: x["base"])).alias("b")).collect():
        assert r["b"] == base_spans(texts[r["doc_id"]] or "")
    assert pii.find_spans(df.where("false")).count() == 0


def test_checksums_and_context(spark):
    texts = ["iban GB82 WEST 1234 5698 7654 32", "iban GB82 WEST 1234 5698 7654 33", "ssn 123-45-6789", "no. 123-45-6789", "1" * 200_000, "a" * 200_000]
    df = documents(spark, texts)
    got = {r["doc_id"]: r["s"] for r in pii.find_spans(df).select("doc_id", pii.joined_spans(F.col("pii_spans")).alias("s")).collect()}
    assert got == {0: "iban:5:32", 1: "", 2: "ssn:4:15", 3: "", 4: "", 5: ""}


def test_account_numbers_end_before_what_follows(spark):
    def check_digits(country, rest):
        return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"

    german, long = "DE89370400440532013000", "XX" + check_digits("XX", "12345678ABCDEF") + "12345678ABCDEF"
    spans = lambda *found: ",".join(f"iban:{a}:{b}" for a, b in found)
    cases = {
        f"IBAN {german} Please": spans((5, 27)),
        "IBAN DE89 3704 0044 0532 0130 00 Bitte zahlen": spans((5, 32)),
        f"IBAN {german} 2024": spans((5, 27)),
        f"IBAN {german} EUR 5": spans((5, 27)),
        f"IBAN {german} GB82 WEST 1234 5698 7654 32 Or": spans((5, 27), (28, 55)),
        f"REF AB12 {german} A": spans((9, 31)),
        f"IBAN {german}x": "",
        f"IBAN {german[:-1]} Please": "",
        f"IBAN {long} Please": spans((5, 23)),  # no known length: the checksum chooses the end
        f"IBAN {long} 2024 EUR": spans((5, 23)),
    }
    got = {r["doc_id"]: r for r in pii.find_spans(documents(spark, list(cases))).select("doc_id", F.filter("pii_spans", lambda x: x["kind"] == "iban").alias("s")).collect()}
    assert [spans(*((x["start"], x["stop"]) for x in got[i]["s"])) for i in range(len(cases))] == list(cases.values())
    text = pii.redact(documents(spark, [f"IBAN {german} Please"])).first()["text"]
    assert text == "IBAN <iban> Please"


def test_redaction(spark):
    df = documents(spark, ["🙂 mail me@x.org now", "plain", None, "+1 (212) 555-0123"])
    got = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert got == {0: "🙂 mail <email> now", 1: "plain", 2: None, 3: "<phone>"}


# --- 5: I-Match


def test_fingerprints_of_edited_texts(spark):
    texts = [None, "", "abc", "a b c d e f g h", "Zwölf große Wörter sind hier zu lesen", "🙂" * 9, LONG, "Zwölf große Wörter sind hier zu lesen"]
    df = documents(spark, texts, parts=F.lit("clash"), head=F.lit("clash"))
    rows = sorted(imatch.fingerprint_with_edits(df.union(df.where("doc_id = 3"))).collect(), key=lambda r: r["id"])
    assert len(rows) == len(texts) + 1
    of = {r["id"]: r for r in rows}
    for i, t in enumerate(texts):
        t, following = t or "", texts[(i + 1) % len(texts)] or ""
        n = len(t) // 4
        assert of[i]["edited"] == t[: len(t) - n] + following[:n]
        assert of[i]["next_parts"] == of[(i + 1) % len(texts)]["parts"]
    assert of[4]["parts"] == of[7]["parts"] and of[0]["parts"] == of[1]["parts"]
    assert of[4]["parts"] != of[3]["parts"]
    single = imatch.fingerprint_with_edits(documents(spark, ["abcd efgh"])).first()
    assert single["edited"] == "abcd efab" and single["parts"] == single["next_parts"]
    assert imatch.fingerprint_with_edits(df.where("false")).count() == 0


def test_likeness_tells_edited_from_other_documents(spark):
    df = queries.op5_imatch(spark, "/root/testdata/sf0.001")
    edited, other = df.agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert edited > 0.45 and other < 0.1
    assert df.where("near_edited < 0 or near_edited > 1 or near_next < 0 or near_next > 1").count() == 0


# --- 8: sharding


def test_flow_costs_no_more_than_any_assignment():
    rng = np.random.default_rng(19)
    for _ in range(30):
        n, m = rng.integers(1, 4), rng.integers(1, 4)
        supply = rng.integers(0, 4, n)
        demand = rng.multinomial(supply.sum(), np.ones(m) / m)
        cost = rng.integers(0, 9, (n, m)).astype(float)
        flow = sharding.min_cost_flow(supply, demand, cost)
        assert (flow.sum(axis=1) == supply).all() and (flow.sum(axis=0) == demand).all() and (flow >= 0).all()
        rows = [i for i in range(n) for _ in range(supply[i])]
        best = min_assignment(rows, tuple(demand), cost)
        assert abs((flow * cost).sum() - best) < 1e-9


def min_assignment(rows, demand, cost, at=0):
    if at == len(rows):
        return 0.0
    options = []
    for t, room in enumerate(demand):
        if room:
            rest = demand[:t] + (room - 1,) + demand[t + 1 :]
            options.append(cost[rows[at], t] + min_assignment(rows, rest, cost, at + 1))
    return min(options)


def test_documents_in_shards(spark):
    rows = [(i % 90, None if i % 11 == 0 else "ß" * (i % 50), "en", None if i % 7 == 0 else f"src{i % 3}", 0) for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("slot", F.lit("clash"))
    got = sharding.document_shards(df, old_shards=4, shards=7).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in rows)
    assert all(r["size"] == len((r["text"] or "").encode()) + 8 for r in got)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    assert sharding.document_shards(df.where("false")).count() == 0


# --- 9: vectors


def test_vectors_link_exactly(spark):
    rng = np.random.default_rng(23)
    centres = rng.standard_normal((12, 20))
    rows = []
    for i in range(400):
        c = centres[i % 12] + rng.standard_normal(20) * rng.choice([0.0, 0.02, 0.1, 0.14, 0.2])
        rows.append((i, (c * rng.uniform(0.1, 9)).astype(np.float32).tolist(), int(i % 12 // 4)))
    rows += [(1000, rows[0][1], None), (1001, None, 0), (1002, [0.0] * 20, 0), (1003, [float("nan")] * 20, 0), (1004, [None] + [1.0] * 19, 0), (1005, rows[0][1][:7], 0), (1006, rows[0][1][:7], 0), (1007, [], 0), (1008, [float("inf")] * 20, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rep", F.lit("clash"))
    nameless = df.where("vec_id in (0, 1001)").withColumn("vec_id", F.lit(None).cast("long"))
    found = vectors.near_duplicate_vectors(df.union(df.where("vec_id = 3")).union(nameless)).collect()
    places = [*rows, rows[3], (None, *rows[0][1:]), (None, None, 0)]  # a repeated row, one without an id, one with neither
    good = [(k, np.array(v, float), x) for k, (_, v, x) in enumerate(places) if x is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for a, v, x in good for b, w, y in good if a < b and x == y and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98]
    degree = Counter(x for e in links for x in e)
    roots = same_components(links, list(range(len(places))))
    least = {}
    for k, (i, *_) in enumerate(places):
        least.setdefault(roots[k], []).extend([] if i is None else [i])
    want = Counter()
    for k, (i, *_) in enumerate(places):
        root = min(least[roots[k]], default=None)
        want[i, degree[k], root, i is not None and i == root] += 1
    assert len(links) > 300
    assert Counter((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in found) == want
    assert vectors.near_duplicate_vectors(df.where("false")).count() == 0
