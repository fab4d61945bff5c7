from __future__ import annotations

import collections
import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barloom.llm import hard_negatives, language, periodic_runs, queries


# Periodic runs


def plain_runs(words, least=24, repeats=3):
    """Every stretch of equal words on every diagonal; a run's period is the least of those that cover it."""
    n, found = len(words), []
    for q in range(1, n // repeats + 1):
        start = None
        for i in range(n - q + 1):
            same = i < n - q and words[i] == words[i + q]
            if same and start is None:
                start = i
            if not same and start is not None:
                if i + q - start >= max(least, repeats * q):
                    found.append((start, i + q - start, q))
                start = None
    return sorted(r for r in found if not any(o[2] < r[2] and o[0] <= r[0] and sum(o[:2]) >= sum(r[:2]) for o in found))


def periodic_words(rng, n):
    """Words of few kinds with repeats of many periods, nested ones too."""
    out = []
    while len(out) < n:
        unit = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40]))]
        if rng.random() < 0.3:
            unit = unit * rng.randrange(1, 4) + unit[: len(unit) // 2]
        out += unit * rng.randrange(1, 6) + unit[: rng.randrange(len(unit))]
    return out[:n]


@pytest.mark.parametrize("seed", range(12))
def test_runs_of_words(seed):
    rng = random.Random(seed)
    for n in (0, 1, 23, 24, 25, 90, 400):
        words = periodic_words(rng, n)
        assert periodic_runs.runs_of(np.array(words, np.int64)) == plain_runs(words)
        assert periodic_runs.runs_of(np.array(words, np.int64), 6, 4) == plain_runs(words, 6, 4)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=120))
def test_runs_of_two_words(words):
    assert periodic_runs.runs_of(np.array(words, np.int64), 5, 3) == plain_runs(words, 5, 3)


def test_one_extension_for_each_run(monkeypatch):
    """Pairs inside a run already found are suppressed, so a long run is extended once."""
    calls, whole = [], periodic_runs.stretch
    monkeypatch.setattr(periodic_runs, "stretch", lambda *a: calls.append(a) or whole(*a))
    assert periodic_runs.runs_of(np.tile(np.arange(5), 4000)) == [(0, 20_000, 5)]
    assert len(calls) == 1


def run_rows():
    rng = random.Random(5)
    texts = [" ".join(f"w{x}" for x in periodic_words(rng, n)) for n in (30, 60, 100, 250, 800)]
    rows = [(i, rng.choice(texts).replace(" ", rng.choice([" ", "\n", "\t\x0b"]), 3) if i % 3 else " ".join(f"u{rng.random()}" for _ in range(rng.randrange(60)))) for i in range(120)]
    return [*rows, (None, texts[1]), (None, None), (7, texts[3]), (7, texts[3]), (500, ""), (501, " \n\t"), (502, "q" * 300_000), (503, "x " * 50_000), (504, "é\x1cx é\x1cx " * 30)]


def plain_answer(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a, m = g % n, 3 + g % 8
        p = 1 + (n - a) // m
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    if n > 5000:
        runs = [(0, n, 1)] if len(set(words)) == 1 and n >= 24 else []
    else:
        runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, digest("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_query(spark, monkeypatch):
    docs = spark.createDataFrame(run_rows(), "doc_id long, text string").withColumns({"runs": F.lit("x"), "n_words": F.lit("y"), "batch": F.lit(None).cast("string")})
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    got = collections.Counter(tuple(r) for r in queries.op11_periodic_runs(spark, "").collect())
    assert got == collections.Counter(plain_answer(*r) for r in run_rows())
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in run_rows())
    out = periodic_runs.with_runs(docs)
    assert out.columns == ["doc_id", "text", "batch", "n_words", "runs", "collapsed"]
    assert periodic_runs.with_runs(docs.where("false")).count() == 0


# Languages


def test_gradients_of_the_byte_network():
    rng = np.random.default_rng(1)
    p = {k: v.astype(np.float64) for k, v in language.start(3, rng).items()}
    windows = rng.integers(0, 256, (5, language.WINDOW)).astype(np.uint8)
    target = np.array([0, 1, 2, 1, 0])
    _, g = language.gradients(p, windows, target)
    for name in p:
        place = tuple(rng.integers(0, s) for s in p[name].shape) if name != "bytes" else (int(windows[0, 0]), 0)
        for at in (place, np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)):
            old = p[name][at]
            p[name][at] = old + 1e-6
            high = language.gradients(p, windows, target)[0]
            p[name][at] = old - 1e-6
            low = language.gradients(p, windows, target)[0]
            p[name][at] = old
            assert abs((high - low) / 2e-6 - g[name][at]) < 1e-4


def plain_shares(net, raw):
    """The network by its definition, filter by filter and place by place."""
    total, weights = 0, 0
    step, size = language.WINDOW - language.SHARED, language.WINDOW
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    at = 0
    while True:
        window, adds = lower[at : at + size].ljust(size, b"\0"), min(step, max(1, len(raw) - at))
        last = at + size >= len(raw)
        adds = max(1, len(raw) - at) if last else step
        pools = []
        for w in language.WIDTHS:
            answers = [sum(net.p["bytes"][window[i + j]].astype(float) @ net.p[f"w{w}"][j].astype(float) for j in range(w)) for i in range(size - w + 1)]
            pools.append(np.max(answers, axis=0))
        logits = np.maximum(np.concatenate(pools) + net.p["b"], 0) @ net.p["out"].astype(float) + net.p["out0"]
        share = np.exp(logits - logits.max())
        total, weights = total + adds * share / share.sum(), weights + adds
        if last:
            return total / weights
        at += step


def test_byte_network_over_whole_texts():
    net = language.Network(language.start(3, np.random.default_rng(4)), ["a", "b", "c"])
    rng = random.Random(2)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 2, 255, 256, 257, 253 * 2 + 3, 253 * 2 + 4, 1500)]
    got = net.shares(texts)
    assert np.allclose(got, [plain_shares(net, t) for t in texts], atol=1e-5)
    assert np.array_equal(got[3:5], net.shares(texts[3:5]))


def language_rows(n=240):
    rng = random.Random(6)
    letters = {"aa": "abcdeéß", "bb": "ghijkñ", "cc": "mnopqü", "dd": "стуфх"}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(letters))
        words = ["".join(rng.choice(letters[lang] + "xyz") for _ in range(rng.randrange(2, 9))) for _ in range(rng.choice([3, 10, 200, 700]))]
        rows.append((i, " ".join(words), lang if i % 11 else None))
    odd = [(n, None, "aa"), (n + 1, "", "bb"), (n + 2, "12 3.4 !?\n", "cc"), (None, "abc abd dac éab", "aa"), (5, rows[5][1], rows[5][2]), (n + 3, "стуфх " * 30_000, None)]
    return [*rows, *odd]


def test_languages(spark):
    rows = language_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5).withColumns({"score": F.lit("x"), "window": F.lit(1)})
    model = language.fit(docs)
    assert model.languages == ["aa", "bb", "cc", "dd"]
    out = language.identify(docs.drop("lang"), model)
    assert out.columns == ["doc_id", "text", "window", "lang_pred", "score"]
    got = {(r.doc_id, r.text): r for r in out.collect()}
    held = {r.doc_id for r in docs.where(language.held_out(F.col("doc_id"))).collect()}
    assert held == {i for i, _, _ in rows if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    asked = [r for r in rows if r[0] in held and r[2] and r[1] and any(c.isalpha() for c in r[1])]
    assert len(asked) > 50
    assert sum(got[r[:2]].lang_pred == r[2] for r in asked) >= 0.97 * len(asked)
    for i, text, _ in rows:
        if not text or not any(c.isalpha() for c in text):
            assert (got[i, text].lang_pred, got[i, text].score) == ("und", 0.0)
        else:
            assert 0 <= got[i, text].score <= 1
    assert got[243, "стуфх " * 30_000].lang_pred == "dd"
    again = language.identify(docs.drop("lang").repartition(2), language.fit(docs.repartition(3)))
    assert sorted((str(r.doc_id), r.lang_pred, r.score) for r in again.collect()) == sorted((str(r.doc_id), r.lang_pred, r.score) for r in got.values() for _ in range(1 + (r.doc_id == 5)))


def test_languages_learn_only_from_their_fold(spark):
    """Labels of held-out rows, of rows without an id, and of texts without letters change nothing."""
    docs = spark.createDataFrame(language_rows(90), "doc_id long, text string, lang string")
    odd = F.when(language.held_out(F.col("doc_id")) | F.col("doc_id").isNull() | ~F.col("text").rlike(r"\p{L}"), "zz").otherwise(F.col("lang"))
    one, two = language.fit(docs), language.fit(docs.withColumn("lang", odd))
    assert one.languages == two.languages
    assert all(np.array_equal(one.p[k], two.p[k]) for k in one.p)


def test_languages_of_few_rows(spark):
    docs = spark.createDataFrame(language_rows(30), "doc_id long, text string, lang string")
    assert language.fit(docs.where("false")) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    one = language.fit(docs.where("lang = 'aa'"))
    assert one == "aa"
    assert {(r.lang_pred, r.score) for r in language.identify(docs, one).collect()} == {("aa", 1.0), ("und", 0.0)}
    assert language.identify(docs.where("false"), one).count() == 0
    few = language.fit(docs, sample=4, each=2, windows=1)
    assert len(few.languages) == 4


# Hard negatives


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 70), st.integers(0, 70), st.integers(0, 70), st.integers(0, 5), st.integers(1, 9))
def test_strassen(m, k, n, seed, leaf):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(1 << 20), 1 << 20, (m, k)), rng.integers(-(1 << 20), 1 << 20, (k, n))
    assert np.array_equal(hard_negatives.strassen(a, b, leaf), a @ b)


def test_strassen_near_the_end_of_64_bits():
    a = np.array([[1 << 29, (1 << 29) - 1, 3], [-(1 << 29), 1, 0], [7, 1 << 29, -5]], np.int64)
    assert hard_negatives.strassen(a, a.T.copy(), 1).tolist() == (a.astype(object) @ a.T.astype(object)).tolist()


def vector_rows(n=700):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(4, 6))
    rows = []
    for i in range(n):
        label = int(rng.integers(0, 4)) if i % 3 else 0
        v = np.round(centre[label] * 4 + centre[(label + i) % 4] * 3 + rng.normal(size=6), 1).tolist()
        rows.append((i, label, v))
    rows += [(1000, None, rows[0][2]), (1001, 0, None), (1002, 0, [1.0, None]), (1003, 1, [float("nan")] * 6), (1004, 1, [float("inf")] + [1.0] * 5), (1100, 0, [1e30] * 6), (None, 0, rows[0][2])]
    rows += [(1200, 1, rows[7][2]), (1200, 1, rows[7][2]), (1200, 0, rows[8][2]), (1300, 2, []), (1400, 2, [3.0, -2.0]), (1401, 2, rows[7][2][:3]), (1500, 9, rows[11][2])]
    return rows


def plain_mine(rows, anchor, n_pos=5, n_neg=5):
    one = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        w = [int(np.floor(256 * x)) for x in v]
        if sum(float(x) ** 2 for x in w) < 2.0**60:
            one[i] = min(one.get(i, (str(label), w)), (str(label), w))
    out = []
    for a in filter(anchor, one):
        score = {i: sum(x * y for x, y in zip(one[a][1], w, strict=False)) for i, (_, w) in one.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if one[i][0] == one[a][0]][:n_pos]:
            inside = [i for i in order if one[i][0] != one[a][0] and 80 * score[p] <= 100 * score[i] <= 100 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(inside[:n_neg])]
    return sorted(out)


@pytest.mark.parametrize("block", [40, 1000])
def test_hard_negatives(spark, block):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(5)
    vectors = df.withColumn("vector", hard_negatives.quantised(F.col("embedding"), 256)).withColumns({"key": F.lit("x"), "side": F.lit("y"), "entry": F.lit("z"), "found": F.lit(1)})
    got = hard_negatives.mine(vectors, F.col("vec_id") % 25 == 0, block=block)
    want = plain_mine(rows, lambda i: i % 25 == 0)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert len({r[0] for r in want}) > 15
    assert hard_negatives.mine(vectors.where("false"), F.col("vec_id") % 25 == 0).count() == 0
    assert hard_negatives.mine(vectors.where("label = 0"), F.col("vec_id") % 25 == 0).count() == 0


def test_hard_negatives_refuse_odd_windows(spark):
    with pytest.raises(ValueError):
        hard_negatives.mine(spark.range(1), F.lit(True), low=Fraction(81, 100))
