"""Periodic runs of words: seed-and-extend on the diagonals of each document.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends and
that is at least `least` words and `repeats` periods long. On the diagonal of lag q its words equal
those q further on for max(least - q, (repeats - 1) * q) places or more. So lags go by classes: those
below the least such overlap of all lags (16 words for 24 and 3), then [16, 32), [32, 64) and so on,
each with the longest power of two that every run of the class is sure to repeat as its k-gram
length. As a k-gram is never shorter than a period of its class, a run's k-gram comes back first
after one smallest period: only neighbouring occurrences of a k-gram in the same document are
paired, one for each place at most. A pair is extended both ways on its diagonal; a table of the
place up to which each lag is covered suppresses the pairs that lie in a run already found.

K-grams are numbered exactly by doubling, without hashes; a hash only passes over documents in
which no k-gram of the first class repeats. Work is n log n words for a document of n, whatever its
content, and rows are independent: there is no shuffle.

Defined cases: a null text has no words and no runs and collapses to an empty text; a null id is an
id like others; repeated rows give repeated results; one word of any length is one word; other
columns pass through, but those named like the result are replaced; an empty table gives an empty
table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import mix64
from barloom.llm.tokens import steps

#: Least length of a run in words, and in periods.
LEAST, REPEATS = 24, 3
RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Numbers(dict):
    """Numbers things in the order in which they come."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def first_overlap(least: int, repeats: int) -> int:
    """The greatest power of two that is no longer than what any run repeats on its diagonal."""
    if repeats < 3:
        raise ValueError("runs of fewer than three periods have no k-gram as long as their period to repeat")
    sure = min(max(least - q, (repeats - 1) * q) for q in range(1, max(2, least + 1)))
    return 1 << (sure.bit_length() - 1)


def repeated(numbers: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """Which of the documents with these sizes, one after another in numbers, seem to repeat a k-gram (k a power of two)."""
    grams, step, weight = mix64(numbers.astype(np.uint64) + np.uint64(1)), 1, 0x9E3779B97F4A7C55
    while step < k:
        grams = grams[: max(0, len(grams) - step)] * np.uint64(weight) + grams[step:]
        weight, step = pow(weight, 2, 1 << 64), 2 * step
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)[: len(grams)]
    whole = np.flatnonzero(np.arange(len(grams)) + k <= ends[owner])
    # the owner is hashed in, so that only repeats within a document meet
    keys = mix64(grams[whole] ^ mix64(owner[whole].astype(np.uint64)))
    order = np.argsort(keys)
    again = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(sizes), bool)
    out[owner[whole[order[1:][again]]]] = True
    return out


def stretch(words: np.ndarray, lag: int, at: int) -> tuple[int, int]:
    """The longest [start, end) around a place where words equal those a lag further on."""
    n = len(words) - lag
    end, step = at, 64
    while end < n:
        equal = words[end : min(n, end + step)] == words[end + lag : min(n, end + step) + lag]
        if not equal.all():
            end += int(equal.argmin())
            break
        end, step = end + len(equal), 2 * step
    start, step = at, 64
    while start > 0:
        low = max(0, start - step)
        equal = words[low:start] == words[low + lag : start + lag]
        if not equal.all():
            start -= int(equal[::-1].argmin())
            break
        start, step = low, 2 * step
    return start, end


def runs_of(words: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a document's numbered words, by start, then period."""
    names, k, low, out = np.unique(words, return_inverse=True)[1].astype(np.int64), 1, 1, []
    first = first_overlap(least, repeats)
    while 2 * k <= len(words):
        pairs = names[: len(names) - k] * (int(names.max()) + 1) + names[k:]
        names, k = np.unique(pairs, return_inverse=True)[1].astype(np.int64), 2 * k
        if k < first:
            continue
        order = np.argsort(names, kind="stable")
        again = names[order][1:] == names[order][:-1]
        if not again.any():
            break
        seeds, lags = order[:-1][again], (order[1:] - order[:-1])[again]
        mine = (lags >= low) & (lags < k)
        seeds, lags = seeds[mine], lags[mine]
        order = np.lexsort((seeds, lags))
        seeds, lags = seeds[order], lags[order]
        for i, j in zip(*bounds(lags), strict=True):
            lag, places = int(lags[i]), seeds[i:j]
            covered, at = 0, 0
            while (at := at + int(np.searchsorted(places[at:], covered))) < len(places):
                start, covered = stretch(words, lag, int(places[at]))
                if covered - start + lag >= max(least, repeats * lag):
                    out.append((start, covered - start + lag, lag))
        low = k
    return sorted(out, key=lambda run: (run[0], run[2]))


def bounds(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the stretches of equal values begin and end."""
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return (np.concatenate([[0], cut]), np.concatenate([cut, [len(values)]])) if len(values) else (cut, cut)


def kept_of(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words are left when each run keeps its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth[:n]) == 0


def with_runs(docs: DataFrame, column: str = "text", least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """All rows and columns of docs with n_words, runs (start, length and period in words) and collapsed, the text with the first period of each run."""
    k = first_overlap(least, repeats)
    others = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]

    def rows(batches):
        for batch in batches:
            for part in steps(batch, column):
                # bytes.split() cuts at blanks and the controls from tab to carriage return
                words = [(t or "").encode().split() for t in part.column(column).to_pylist()]
                sizes, number = np.array([len(w) for w in words]), Numbers()
                flat = np.fromiter((number[x] for w in words for x in w), np.int64, int(sizes.sum()))
                found, begin = [[] for _ in words], np.cumsum(sizes) - sizes
                for i in np.flatnonzero(repeated(flat, sizes, k)):
                    found[i] = runs_of(flat[begin[i] : begin[i] + sizes[i]], least, repeats)
                collapsed = []
                for w, runs in zip(words, found, strict=True):
                    left = [w[i] for i in np.flatnonzero(kept_of(len(w), runs))] if runs else w
                    collapsed.append(b" ".join(left).decode())
                named = [[{"start": s, "length": n, "period": p} for s, n, p in runs] for runs in found]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(sizes, pa.int64()), pa.array(named, RUN), pa.array(collapsed, pa.string())], [*others, "n_words", "runs", "collapsed"])

    docs = docs.select(*others)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(rows, f"{schema}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def most_periodic(runs: Column) -> Column:
    """The run with the greatest length in periods, of equal ones the first, then the one of least period; null where there is none."""

    def better(a: Column, b: Column) -> Column:
        return F.when(b["length"].cast("decimal(19,0)") * a["period"] > a["length"].cast("decimal(19,0)") * b["period"], b).otherwise(a)

    # runs come by start, then period, so the first of equal ones stays
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.get(runs, 0), better))


def planted(doc_id: Column, text: Column) -> Column:
    """The text, of one document in ten with its words from some place on repeated periodically, as its id's checksum says."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)

    def repeat(words: Column) -> Column:
        n, g = F.size(words), F.floor(h / 10)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    # a lambda over a list of one, so that the words are taken once
    changed = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(text)), 0)
    return F.when(text.isNotNull() & (h % 10 == 0), changed).otherwise(text)
