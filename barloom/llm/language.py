"""Language identification by a byte convolutional network, trained in numpy.

A window of WINDOW bytes of a text, A-Z lower-cased and short ones filled up with zero bytes, passes
filters of several widths over trained byte vectors; each filter's greatest answer in the window goes
through a rectifier to a softmax over the languages of the training rows. A document's share of a
language is the mean over all windows of its whole text, each weighing as many bytes as it adds.

A filter over byte vectors is a sum of table entries, one table for each place of the filter; to
score, places are joined two by two, so that a filter of width 4 looks up two pairs of bytes.

Training draws a bounded sample: at most `each` rows of a language and `sample` in all, in the order
of a hash of their ids, and at most `windows` windows of each, at hashed places anywhere in its text.
Only these windows reach the driver.

Defined cases: a text that is null or holds no letter (empty ones included) is "und" with score 0; so
is every text if no row can train; rows with a null id, text or language don't train; with one
language all other texts are of it with score 1; repeated rows are answered alike; other columns
pass through, but those named like the result are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.tokens import steps

#: Rows, rows of a language, and windows of a row that train, at most.
SAMPLE, EACH, WINDOWS = 2400, 600, 8
#: Bytes of a window, widths of filters, filters of a width, size of a byte's vector.
WINDOW, WIDTHS, FILTERS, SIZE = 256, (2, 3, 4), 24, 8
#: Bytes that a window shares with the next one, so that no filter loses its place.
SHARED = max(WIDTHS) - 1
#: Windows scored at once.
ROWS = 1024
UNKNOWN = "und"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def windows_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """([window, byte], bytes that each window adds) over a whole text."""
    step = WINDOW - SHARED
    n = max(1, -(-max(0, len(raw) - SHARED) // step))
    data = np.zeros((n - 1) * step + WINDOW, np.uint8)
    data[: len(raw)] = _LOWER[np.frombuffer(raw, np.uint8)]
    weight = np.full(n, step, np.float64)
    weight[-1] = max(1, len(raw) - (n - 1) * step)
    return np.lib.stride_tricks.sliding_window_view(data, WINDOW)[::step], weight


def tables(p: dict, width: int) -> list[np.ndarray]:
    """What each byte adds to the filters of a width, for each place."""
    return [p["bytes"] @ p[f"w{width}"][j] for j in range(width)]


class Network:
    def __init__(self, params: dict, languages: list[str]) -> None:
        self.p, self.languages, self.pairs = params, languages, None

    def __getstate__(self):
        return {"p": self.p, "languages": self.languages, "pairs": None}

    def lookups(self) -> dict[int, list[tuple[int, int, np.ndarray]]]:
        """For each width (place, bytes looked up, table): two bytes at once, and the last one of odd widths."""
        if self.pairs is None:
            self.pairs = {}
            for width in WIDTHS:
                each, parts = tables(self.p, width), []
                for j in range(0, width - 1, 2):
                    parts.append((j, 2, (each[j][:, None, :] + each[j + 1][None, :, :]).reshape(1 << 16, FILTERS)))
                if width % 2:
                    parts.append((width - 1, 1, each[-1]))
                self.pairs[width] = parts
        return self.pairs

    def windows(self, windows: np.ndarray) -> np.ndarray:
        """[window, language] shares."""
        out = np.empty((len(windows), len(self.languages)))
        for i in range(0, len(windows), ROWS):
            at = np.ascontiguousarray(windows[i : i + ROWS].T).astype(np.int64)
            two = (at[:-1] << 8) | at[1:]
            pools = []
            for width in WIDTHS:
                best = np.full((at.shape[1], FILTERS), -np.inf, np.float32)
                total, more = np.empty_like(best), np.empty_like(best)
                for t in range(WINDOW - width + 1):
                    for k, (j, n, table) in enumerate(self.lookups()[width]):
                        np.take(table, two[t + j] if n == 2 else at[t + j], axis=0, out=more if k else total, mode="clip")
                        if k:
                            total += more
                    np.maximum(best, total, out=best)
                pools.append(best)
            hidden = np.maximum(np.concatenate(pools, axis=1) + self.p["b"], 0).astype(np.float64)
            logits = (hidden[:, :, None] * self.p["out"].astype(np.float64)[None]).sum(axis=1) + self.p["out0"]
            share = np.exp(logits - logits.max(axis=1, keepdims=True))
            out[i : i + ROWS] = share / share.sum(axis=1, keepdims=True)
        return out

    def shares(self, texts: list[bytes]) -> np.ndarray:
        """[text, language] shares of whole texts."""
        parts = [windows_of(t) for t in texts]
        share = self.windows(np.concatenate([w for w, _ in parts]))
        weight = np.concatenate([w for _, w in parts])
        first = np.cumsum([0, *(len(w) for w, _ in parts[:-1])])
        return np.add.reduceat(share * weight[:, None], first) / np.add.reduceat(weight, first)[:, None]


def gradients(p: dict, windows: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
    """Mean cross entropy over windows, and its gradients; a filter learns at its greatest answer alone."""
    pools, places = [], []
    for width in WIDTHS:
        n = WINDOW - width + 1
        answer = sum(table[windows[:, j : j + n]] for j, table in enumerate(tables(p, width)))
        at = answer.argmax(axis=1)
        places.append(at)
        pools.append(np.take_along_axis(answer, at[:, None, :], axis=1)[:, 0, :])
    raw = np.concatenate(pools, axis=1) + p["b"]
    hidden = np.maximum(raw, 0)
    logits = hidden @ p["out"] + p["out0"]
    logits -= logits.max(axis=1, keepdims=True)
    share = np.exp(logits)
    share /= share.sum(axis=1, keepdims=True)
    rows = np.arange(len(windows))
    loss = float(-np.log(np.maximum(share[rows, target], 1e-12)).mean())
    d = share.copy()
    d[rows, target] -= 1
    d /= len(windows)
    d_raw = (d @ p["out"].T) * (raw > 0)
    g = {"out": hidden.T @ d, "out0": d.sum(axis=0), "b": d_raw.sum(axis=0), "bytes": np.zeros_like(p["bytes"])}
    for k, width in enumerate(WIDTHS):
        d_pool, own = d_raw[:, k * FILTERS : (k + 1) * FILTERS], []
        for j in range(width):
            seen = np.take_along_axis(windows, places[k] + j, axis=1)
            own.append(np.einsum("rfs,rf->sf", p["bytes"][seen], d_pool))
            np.add.at(g["bytes"], seen, d_pool[:, :, None] * p[f"w{width}"][j].T[None])
        g[f"w{width}"] = np.stack(own)
    return loss, g


def start(languages: int, rng: np.random.Generator) -> dict:
    p = {"bytes": rng.normal(size=(256, SIZE)), "b": np.zeros(len(WIDTHS) * FILTERS), "out": rng.normal(size=(len(WIDTHS) * FILTERS, languages)) / np.sqrt(len(WIDTHS) * FILTERS), "out0": np.zeros(languages)}
    p |= {f"w{w}": rng.normal(size=(w, SIZE, FILTERS)) / np.sqrt(w * SIZE) for w in WIDTHS}
    return {k: v.astype(np.float32) for k, v in p.items()}


def train(windows: list[bytes], languages: list[str], passes: int = 4, seed: int = 9) -> Network | str | None:
    """A network, the language if there is one alone, or None without windows. Half of the windows also train cut short."""
    names = sorted(set(languages))
    if len(names) < 2:
        return names[0] if names else None
    rng = np.random.default_rng(seed)
    data = np.zeros((len(windows), WINDOW), np.uint8)
    for row, raw in zip(data, windows, strict=True):
        row[: len(raw)] = _LOWER[np.frombuffer(raw, np.uint8)]
    target = np.searchsorted(names, languages)
    p = start(len(names), rng)
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for _ in range(passes):
        order = rng.permutation(len(data))
        for part in np.array_split(order, max(1, len(order) // 64)):
            step += 1
            batch = data[part].copy()
            for row in batch[::2]:
                row[int(rng.integers(8, WINDOW)) :] = 0
            _, grads = gradients(p, batch, target[part])
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                p[k] -= (0.005 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-6)).astype(np.float32)
    return Network(p, names)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def cut(docs: DataFrame, windows: int) -> DataFrame:
    """(place, lang, window): at most `windows` windows of each text, at places hashed from its id."""

    def rows(batches):
        for b in batches:
            place, lang, data = [], [], []
            for i in range(b.num_rows):
                raw, name = b.column("text")[i].as_py().encode(), b.column("doc_id")[i].as_py()
                last = max(0, len(raw) - WINDOW)
                for at in sorted({xxhash.xxh3_64_intdigest(f"{name}.{k}") % (last + 1) for k in range(windows)}):
                    place.append(f"{name}.{at}")
                    lang.append(b.column("lang")[i].as_py())
                    data.append(raw[at : at + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.string()), pa.array(lang, pa.string()), pa.array(data, pa.binary())], ["place", "lang", "window"])

    return docs.select("doc_id", "text", "lang").mapInArrow(rows, "place string, lang string, window binary")


def fit(docs: DataFrame, sample: int = SAMPLE, each: int = EACH, windows: int = WINDOWS) -> Network | str | None:
    """Train on the rows of docs(doc_id, text, lang) that are not held out, at most `each` of a language and `sample` in all."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "lang", F.xxhash64(F.lit(23), F.col("doc_id")).alias("draw"))
    # the first of each language are taken in every task before they are shuffled, so no language is gathered
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    chosen = rows.withColumn("turn", turn).where(F.col("turn") <= each).orderBy("turn", "draw", "doc_id", "lang").limit(sample).select("doc_id", "lang").distinct()
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang").join(F.broadcast(chosen), ["doc_id", "lang"]).where("text is not null")  # `sample` rows at most
    got = cut(texts.dropDuplicates(["doc_id", "lang", "text"]), windows).orderBy("place", "lang", "window").limit(sample * windows).toArrow()
    return train(got["window"].to_pylist(), got["lang"].to_pylist())


def identify(docs: DataFrame, model: Network | str | None) -> DataFrame:
    """All rows and columns of docs with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def rows(batches):
        net = shared.value
        for batch in batches:
            for part in steps(batch, "text"):
                text = part.column("text")
                lettered = np.flatnonzero(np.asarray(pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False)))
                names, score = np.full(part.num_rows, UNKNOWN, object), np.zeros(part.num_rows)
                if len(lettered) and isinstance(net, Network):
                    share = net.shares([t.encode() for t in text.take(pa.array(lettered)).to_pylist()])
                    names[lettered], score[lettered] = np.array(net.languages, object)[share.argmax(axis=1)], np.round(share.max(axis=1), 6)
                elif len(lettered) and net is not None:
                    names[lettered], score[lettered] = net, 1.0
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(names, pa.string()), pa.array(score, pa.float64())], [*others, "lang_pred", "score"])

    docs = docs.select(*others)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(rows, f"{schema}, lang_pred string, score double")
