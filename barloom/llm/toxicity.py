"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as a trained vector (words that the sample knows) beside the mean of trained vectors
of its character n-grams and the highest weight of evidence among these. Two gated recurrent
layers read a window of words from both ends, attention pools their states, and a logistic unit
scores the window. A document's score is that of its highest window; windows overlap by half and
cover the whole text.

Training draws a bounded sample of labelled rows (``sample``) in the order of a hash of their ids,
and learns from each document's highest window, chosen anew in every pass.

Defined cases: a null, empty or blank text is one window without words; labels that are null or
rows without text do not train; with no labelled row of either kind every score is the share of
the other; repeated rows score alike; other columns pass through, but those named like the result
are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import BATCHES, settings
from barloom.llm.tokens import forget, steps

#: Labelled rows that train, at most.
SAMPLE = 2500
WINDOW, STRIDE = 64, 32
#: Sizes: word vector, n-gram vector, states of a direction, attention.
WORD, GRAM, STATES, LOOK = 8, 6, 8, 8
BUCKETS = 1 << 15
#: Bytes of text scored at once; their words, windows and states are some 20 times as large.
STEP = 1 << 20
#: Words whose inputs a worker keeps.
KNOWN = 200_000
CUT = ".,;:!?\"'()[]{}«»…-"


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def grams_of(words: list[str], step: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' 3- to 5-byte n-grams, with marks at both ends, and where each word's begin."""
    parts, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for i in range(0, len(words), step):
        buckets, counts = some_grams(words[i : i + step])
        parts.append(buckets)
        sizes.append(counts)
    return np.concatenate(parts), np.cumsum(np.concatenate(sizes))


def some_grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same for a few words: buckets, and how many each word has."""
    raw = [b"<" + (w.strip(CUT) or w).encode() + b">" for w in words]
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    who, what = [], []
    for n in (3, 4, 5):
        if len(data) < n:
            continue
        code = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            code = code * np.uint64(0x100000001B3) + data[k : len(data) - n + 1 + k]
        inside = owner[: len(code)] == owner[n - 1 :]
        who.append(owner[: len(code)][inside])
        what.append(((code ^ (code >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 15))[inside].astype(np.int32))
    who, what = np.concatenate(who), np.concatenate(what)
    return what[np.argsort(who, kind="stable")], np.bincount(who, minlength=len(raw))


def windows_of(n: int) -> list[int]:
    """Starts of the windows that cover n words."""
    return list(range(0, max(1, n - STRIDE), STRIDE))


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Inputs:
    """Words to input rows: indexes of known words and buckets of n-grams."""

    def __init__(self, vocabulary: dict[str, int], evidence: np.ndarray) -> None:
        self.vocabulary, self.evidence = vocabulary, evidence

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        grams, bounds = grams_of(words)
        known = np.array([self.vocabulary.get(w.strip(CUT), 0) for w in words], np.int64)
        return known, grams, bounds, np.maximum.reduceat(self.evidence[grams], bounds[:-1])

    def rows(self, p: dict, encoded) -> np.ndarray:
        known, grams, bounds, best = encoded
        out = np.empty((len(known), WORD + GRAM + 1), np.float32)
        for i in range(0, len(known), 10_000):
            j = min(i + 10_000, len(known))
            at = bounds[i : j + 1]
            mean = np.add.reduceat(p["grams"][grams[at[0] : at[-1]]], at[:-1] - at[0]) / np.diff(at)[:, None]
            out[i:j] = np.concatenate([p["words"][known[i:j]], mean, best[i:j, None]], axis=1)
        return out


def layer(projected: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False):
    """States of one gated recurrent layer over [time, row, 3 * STATES] inputs; with keep, what its gradient needs."""
    h = np.zeros((projected.shape[1], STATES), np.float32)
    states, trail = np.empty((*projected.shape[:2], STATES), np.float32), []
    for t in range(len(projected)):
        through = h @ u
        gates = sigmoid(projected[t, :, : 2 * STATES] + through[:, : 2 * STATES])
        r, z = gates[:, :STATES], gates[:, STATES:]
        new = np.tanh(projected[t, :, 2 * STATES :] + r * through[:, 2 * STATES :])
        m = mask[t][:, None]
        if keep:
            trail.append((h, r, z, new, through[:, 2 * STATES :], m))
        h = np.where(m, new + z * (h - new), h)
        states[t] = h
    return states, trail


def layer_gradient(d_states: np.ndarray, trail, u: np.ndarray):
    d_in = np.zeros((*d_states.shape[:2], 3 * STATES), np.float32)
    d_u = np.zeros_like(u)
    d_h = np.zeros(d_states.shape[1:], np.float32)
    for t in range(len(trail) - 1, -1, -1):
        h, r, z, new, inner, m = trail[t]
        d = (d_h + d_states[t]) * m
        skip = (d_h + d_states[t]) * ~m
        d_new = d * (1 - z) * (1 - new * new)
        d_z = d * (h - new) * z * (1 - z)
        d_r = d_new * inner * r * (1 - r)
        d_in[t] = np.concatenate([d_r, d_z, d_new], axis=1)
        d_through = np.concatenate([d_r, d_z, d_new * r], axis=1)
        d_u += h.T @ d_through
        d_h = d * z + skip + d_through @ u.T
    return d_in, d_u


def pooled(p: dict, forward: np.ndarray, mask: np.ndarray, backward: np.ndarray):
    """Window logits from [time, row, 3 * STATES] projections; the backward layer reads from the end."""
    f, tf = layer(forward, mask, p["uf"], True)
    b, tb = layer(backward[::-1], mask[::-1], p["ub"], True)
    states = np.concatenate([f, b[::-1]], axis=2)
    seen = np.tanh(states @ p["look"] + p["look0"])
    weight = np.where(mask, seen @ p["ask"], -1e9)
    weight = np.exp(weight - weight.max(axis=0)) * mask
    weight /= np.maximum(weight.sum(axis=0), 1e-9)
    pool = (weight[:, :, None] * states).sum(axis=0)
    return pool @ p["out"] + p["out0"][0], (tf, tb, states, seen, weight, pool)


def logits(p: dict, x: np.ndarray, index: np.ndarray, mask: np.ndarray, step: int = 2048) -> np.ndarray:
    """Window logits without gradients; x holds each word's projections for both directions, index [time, row] its words."""
    out = np.empty(index.shape[1], np.float32)
    for i in range(0, index.shape[1], step):
        at, m = index[:, i : i + step], mask[:, i : i + step]
        f, _ = layer(x[:, : 3 * STATES][at], m, p["uf"])
        b, _ = layer(x[:, 3 * STATES :][at[::-1]], m[::-1], p["ub"])
        states = np.concatenate([f, b[::-1]], axis=2)
        weight = np.where(m, np.tanh(states @ p["look"] + p["look0"]) @ p["ask"], -1e9)
        weight = np.exp(weight - weight.max(axis=0)) * m
        weight /= np.maximum(weight.sum(axis=0), 1e-9)
        out[i : i + step] = np.einsum("tr,trs->rs", weight, states) @ p["out"] + p["out0"][0]
    return out


def framed(index: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """([time, row] word indexes, mask, document of each window)."""
    starts = [windows_of(len(x)) for x in index]
    owner = np.repeat(np.arange(len(index)), [len(s) for s in starts])
    flat = np.empty(sum(map(len, index)) + WINDOW, np.int32)
    base = np.concatenate([[0], np.cumsum([len(x) for x in index])])
    for x, at in zip(index, base.tolist(), strict=False):
        flat[at : at + len(x)] = x
    flat[base[-1] :] = 0
    first = np.concatenate([np.array(s) + base[i] for i, s in enumerate(starts)])
    size = np.minimum(base[owner + 1] - first, WINDOW)
    mask = np.arange(WINDOW)[:, None] < size[None, :]
    frames = np.empty(mask.shape, np.int32)
    for t in range(WINDOW):  # one place of all windows at a time: few copies of what may be a whole sample
        frames[t] = np.where(mask[t], flat[np.minimum(first + t, len(flat) - 1)], 0)
    return frames, mask, owner


class Network:
    def __init__(self, params: dict, inputs: Inputs) -> None:
        self.p, self.inputs = params, inputs
        self.clear()

    def __getstate__(self):
        return {"p": self.p, "inputs": self.inputs}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.zeros((KNOWN, 6 * STATES), np.float32)

    def project(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), 6 * STATES), np.float32)
        for side, place in (("f", out[:, : 3 * STATES]), ("b", out[:, 3 * STATES :])):
            np.add(rows @ self.p["w" + side], self.p["b" + side], out=place)
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Scores of whole texts."""
        words = [words_of(t) for t in texts]
        new = list({w for ws in words for w in ws if w not in self.index})
        if len(self.index) + len(new) > KNOWN:
            self.clear()
            new = list({w for ws in words for w in ws})
        table = self.table
        if len(new) > KNOWN:  # one step of very many words: a table of its own
            table = np.zeros((len(new), 6 * STATES), np.float32)
        at = len(self.index)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            table[at + i : at + i + len(part)] = self.project(self.inputs.rows(self.p, self.inputs.encode(part)))
        self.index.update(zip(new, range(at, at + len(new)), strict=True))
        index, mask, owner = framed([np.fromiter(map(self.index.__getitem__, ws), np.int64, len(ws)) for ws in words])
        if len(new) > KNOWN:
            self.clear()
        best = np.full(len(texts), -np.inf, np.float32)
        size = mask.sum(axis=0)
        order = np.argsort(size, kind="stable")
        for rows in np.array_split(order, np.searchsorted(size[order], [1, 9, 17, 33, 64])):
            if len(rows):
                longest = max(1, int(size[rows].max()))
                np.maximum.at(best, owner[rows], logits(self.p, table, index[:longest, rows], mask[:longest, rows]))
        return sigmoid(best.astype(np.float64))


def evidence(counts: np.ndarray, hits: np.ndarray, share: float) -> np.ndarray:
    """Log odds of the label given presence against without, drawn to zero where there are few cases."""
    p = (hits + 8 * share) / (counts + 8)
    return (np.log(p / (1 - p)) - np.log(share / (1 - share))).astype(np.float32)


def train(texts: list[str], labels: list[int], passes: int = 6, seed: int = 3) -> Network | float:
    """A network, or the share of label 1 where only one label is there."""
    y = np.array(labels, np.float32)
    if len(y) == 0 or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    rng = np.random.default_rng(seed)
    share = float(y.mean())
    number: dict[str, int] = {}
    index = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int64) for t in texts]
    every = list(number)
    bare = sorted({w.strip(CUT) for w in every})
    place = {w: i for i, w in enumerate(bare)}
    to_bare = np.array([place[w.strip(CUT)] for w in every] or [0])
    grams, bounds = grams_of(every) if every else (np.zeros(0, np.int64), np.zeros(1, np.int64))
    n_word, y_word, n_gram, y_gram = (np.zeros(k) for k in (len(bare), len(bare), BUCKETS, BUCKETS))
    for x, label in zip(index, y, strict=True):
        if len(x):
            own = np.unique(x)
            once = np.unique(to_bare[own])
            n_word[once] += 1
            y_word[once] += label
            mine = np.unique(np.concatenate([grams[bounds[i] : bounds[i + 1]] for i in own]))
            n_gram[mine] += 1
            y_gram[mine] += label
    frequent = np.flatnonzero(n_word >= 4)
    vocabulary = {bare[i]: k + 1 for k, i in enumerate(frequent)}
    inputs = Inputs(vocabulary, evidence(n_gram, y_gram, share))
    size = WORD + GRAM + 1

    def start(*shape):
        return (rng.normal(size=shape) / np.sqrt(shape[0])).astype(np.float32)

    p = {"words": 0.1 * start(len(vocabulary) + 1, WORD) * 10, "grams": 0.1 * start(BUCKETS, GRAM) * 10}
    p["words"][1:, 0] += evidence(n_word[frequent], y_word[frequent], share)
    p["grams"][:, 0] += inputs.evidence
    for side in "fb":
        p |= {"w" + side: start(size, 3 * STATES), "b" + side: np.zeros(3 * STATES, np.float32), "u" + side: start(STATES, 3 * STATES)}
    p |= {"look": start(2 * STATES, LOOK), "look0": np.zeros(LOOK, np.float32), "ask": start(LOOK), "out": start(2 * STATES), "out0": np.array([np.log(share / (1 - share))], np.float32)}
    net = Network(p, inputs)
    encoded = inputs.encode(every) if every else None
    frames, mask, owner = framed(index)
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(passes):
        if not every:
            break
        rows = inputs.rows(p, encoded)
        score = logits(p, net.project(rows), frames, mask, 256)
        order = np.lexsort((-score, owner))
        top = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
        extra = rng.permutation(len(owner))
        chosen = np.concatenate([top, extra[y[owner[extra]] == 0][: len(top) // 2]])
        rng.shuffle(chosen)
        for part in np.array_split(chosen, max(1, len(chosen) // 96)):
            step += 1
            grads = gradients(p, encoded, inputs, frames[:, part], mask[:, part], y[owner[part]])
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= (0.01 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    net.clear()
    return net


def gradients(p: dict, encoded, inputs: Inputs, frames: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
    """Gradients of the mean logistic loss over windows."""
    known, grams, bounds, best = encoded
    used, at = np.unique(frames, return_inverse=True)
    at = at.reshape(frames.shape)
    mine = [grams[bounds[i] : bounds[i + 1]] for i in used]
    own = (known[used], np.concatenate(mine), np.concatenate([[0], np.cumsum([len(m) for m in mine])]), best[used])
    rows = inputs.rows(p, own)
    x = rows[at]
    logit, (tf, tb, states, seen, weight, pool) = pooled(p, x @ p["wf"] + p["bf"], mask, x @ p["wb"] + p["bb"])
    d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
    g = {"out": pool.T @ d, "out0": np.array([d.sum()], np.float32)}
    d_pool = d[:, None] * p["out"][None, :]
    d_weight = (states * d_pool[None]).sum(axis=2)
    d_ask = weight * (d_weight - (weight * d_weight).sum(axis=0))
    g["ask"] = np.einsum("tr,trl->l", d_ask, seen)
    d_seen = d_ask[:, :, None] * p["ask"] * (1 - seen * seen)
    g["look"], g["look0"] = np.einsum("trs,trl->sl", states, d_seen), d_seen.sum(axis=(0, 1))
    d_states = weight[:, :, None] * d_pool[None] + d_seen @ p["look"].T
    d_f, g["uf"] = layer_gradient(d_states[:, :, :STATES], tf, p["uf"])
    d_b, g["ub"] = layer_gradient(d_states[::-1, :, STATES:], tb, p["ub"])
    d_b = d_b[::-1]
    g["wf"], g["bf"] = np.einsum("tri,trk->ik", x, d_f), d_f.sum(axis=(0, 1))
    g["wb"], g["bb"] = np.einsum("tri,trk->ik", x, d_b), d_b.sum(axis=(0, 1))
    d_rows = np.zeros_like(rows)
    np.add.at(d_rows, at.ravel(), ((d_f @ p["wf"].T + d_b @ p["wb"].T) * mask[:, :, None]).reshape(-1, rows.shape[1]))
    g["words"], g["grams"] = np.zeros_like(p["words"]), np.zeros_like(p["grams"])
    np.add.at(g["words"], own[0], d_rows[:, :WORD])
    each = np.diff(own[2])
    np.add.at(g["grams"], own[1], np.repeat(d_rows[:, WORD : WORD + GRAM] / each[:, None], each, axis=0))
    return g


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(batches):
    """One row: the model that is trained on the rows of text and toxic, pickled."""
    forget()
    texts, marks = [], []
    for batch in batches:
        texts += batch.column("text").to_pylist()
        marks += batch.column("toxic").to_pylist()
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, marks))], pa.binary())], ["model"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | float:
    """Train on at most `sample` labelled rows that are not held out, in one task; the driver gets the model alone."""
    rows = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropDuplicates(["doc_id"])
    chosen = rows.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])
    texts = texts.repartition(1).sortWithinPartitions("doc_id").select("text", "toxic")  # `sample` rows at most
    with settings(docs.sparkSession, BATCHES):
        models = texts.mapInArrow(learned, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else train([], [])


def score(docs: DataFrame, model: Network | float, threshold: float = 0.3) -> DataFrame:
    """All rows and columns of docs with score and predicted."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in ("score", "predicted")]

    def rows(batches):
        forget()
        net = shared.value
        for batch in batches:
            for part in steps(batch, "text", STEP):
                s = net.score(part.column("text").to_pylist()) if isinstance(net, Network) else np.full(part.num_rows, net)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], [*others, "score", "predicted"])

    docs = docs.select(*others)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(rows, f"{schema}, score double, predicted int")
