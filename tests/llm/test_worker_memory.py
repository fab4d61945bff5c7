"""What operators keep in a worker process, and what training takes in the driver."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from barloom.llm import ngram_join, tokens, toxicity
from barloom.llm.queries import TOKENIZERS

TEXTS = ["one two three four five six", None, "", "seven eight"]


def batch() -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS)], ["doc_id", "text"])


def test_other_operators_free_the_tokenizer():
    before = [ids.tolist() for _, ids, _ in tokens.encoded(iter([batch()]), f"{TOKENIZERS}/byte_bpe_50k.json", 1)]
    assert tokens.encoder.cache_info().currsize
    assert [len(s) for _, sets in ngram_join.sets_of(iter([batch()]), 5) for s in sets] == [2, 0, 0, 1]
    assert not tokens.encoder.cache_info().currsize
    assert [ids.tolist() for _, ids, _ in tokens.encoded(iter([batch()]), f"{TOKENIZERS}/byte_bpe_50k.json", 1)] == before


def test_windows_of_a_sample_take_few_copies():
    rng = np.random.default_rng(5)
    index = [rng.integers(0, 50_000, n).astype(np.int64) for n in [0, 1, 63, 64, 65, 96, 97, *rng.integers(1, 3000, 600).tolist()]]
    tracemalloc.start()
    frames, mask, owner = toxicity.framed(index)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * frames.nbytes
    at = 0
    for k, x in enumerate(index):
        for i in toxicity.windows_of(len(x)):
            own = x[i : i + toxicity.WINDOW]
            assert owner[at] == k and mask[:, at].sum() == len(own)
            assert frames[: len(own), at].tolist() == own.tolist() and not frames[len(own) :, at].any()
            at += 1
    assert at == len(owner)


def test_projections_of_both_directions():
    net = toxicity.train(["bad words here", "fine words there"] * 8, [1, 0] * 8, passes=1)
    rows = np.random.default_rng(7).normal(size=(45_001, toxicity.WORD + toxicity.GRAM + 1)).astype(np.float32)
    want = np.concatenate([rows @ net.p["wf"] + net.p["bf"], rows @ net.p["wb"] + net.p["bb"]], axis=1)
    tracemalloc.start()
    got = net.project(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got, want)
    assert peak < 1.6 * want.nbytes


def test_training_takes_nothing_of_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'bad' if i % 2 else 'fine'} words number {i}") for i in range(60)] + [(None, "no id"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(51, None), (52, 7)], "doc_id long, toxic int")
    rows = [r for r in docs.join(labels.where("toxic < 2"), "doc_id").where(~toxicity.held_out(F.col("doc_id")) & F.col("text").isNotNull()).orderBy("doc_id").collect()]
    want = toxicity.train([r["text"] for r in rows], [r["toxic"] for r in rows])
    monkeypatch.setattr(toxicity, "words_of", None)  # what only training here would call
    got = toxicity.fit(docs, labels)
    assert got.inputs.vocabulary == want.inputs.vocabulary and all(np.array_equal(got.p[k], want.p[k]) for k in want.p)
    assert toxicity.fit(docs, labels.where("doc_id < 0")) == 0.0
    assert toxicity.fit(docs, labels.where("toxic = 1")) == 1.0
