"""The pipeline's stages against brute force, on the smallest tables and on awkward ones."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from test_shingles import components, word_sets
from tokenizers import Tokenizer

from glosswork.llm import langid, quality

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_their_decisions_say(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "personal_data", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    odd = spark.createDataFrame([(10_001, None, "en", "s", 0), (10_002, "", None, None, 0), (10_003, "12345 !!", "en", "s", 8)], docs.schema)
    docs = docs.union(odd).cache()
    after = {}
    frame = docs
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF).cache()
        after[name] = frame
    for name in list(after)[:-1]:
        assert after[name].columns == docs.columns
    language = langid.predict(docs, langid.train(docs, F.lit(True)))
    want = {r["doc_id"] for r in language.where("lang_accepted").collect()}
    assert {r["doc_id"] for r in after["language"].collect()} == want
    assert not want & {10_001, 10_002, 10_003} and len(want) > 190
    model = quality.train(after["language"], labels)
    want = {r["doc_id"] for r in quality.score(after["language"], model).where("quality_score >= 0.3").collect()}
    assert {r["doc_id"] for r in after["quality"].collect()} == want
    texts = {r["doc_id"]: r["text"] for r in after["quality"].collect()}
    kept = {r["doc_id"]: r["text"] for r in after["near_duplicates"].collect()}
    places = sorted(texts)  # the first of each group of texts with 0.8 or more of their five-word shingles in common
    roots = components([word_sets(texts[i]) for i in places])
    assert kept == {places[r]: texts[places[r]] for r in set(roots.values())}
    assert len(kept) < len(texts)
    clean = {r["doc_id"]: r for r in after["personal_data"].collect()}
    assert clean.keys() == kept.keys()
    assert all(r["n_chars"] == len(r["text"]) for r in clean.values())
    assert all(r["text"] == kept[i] for i, r in clean.items() if not any(c in "0123456789@" for c in kept[i]))
    assert not any("@mail" in r["text"] for r in clean.values())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = {}
    for r in after["packing"].collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {i: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for i, r in clean.items()}


def test_run_is_the_stages_in_order(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 100
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns)
