"""Hard negatives for anchors, by Strassen products of whole-number tiles.

Anchors and candidates are dealt into blocks; each pair of blocks is a task's work of bounded size.
Its scores are a product of int64 matrices by Strassen's recursion: both are filled up with zeros
where a side is odd, seven products of halves replace eight, and additions are exact modulo 2**64,
which the scores fit. A tile keeps the first few of each anchor; such lists merge, so
Spark cuts them to as many before and after the shuffle, and nothing grows with the candidates.

The first pass finds each anchor's positives and meets blocks of one label alone; the second finds,
for each positive, the first rows of other labels whose scores lie in its window.

Defined cases: rows with a null id, label or vector, or a null component, take no part, nor do those
whose components' squares sum to 2**60 or more (scores might leave 64 bits); of rows with one id the
one with the smallest label, then vector, takes part; shorter vectors, empty ones too, count as ended
by zeros; a positive without negatives has no row; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import keep
from barloom.llm.vector_dedup import grouped, in_blocks

#: Rows of a block; a tile has at most some BLOCK x BLOCK scores.
BLOCK = 1000
#: Sides up to which products are formed directly.
LEAF = 16
_LEAST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The product of two int64 matrices, modulo 2**64."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :c], b[:j, c:], b[j:, :c], b[j:, c:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * c), np.int64)
    out[:i, :c], out[:i, c:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :c], out[i:, c:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def quantised(vector: Column, scale: float) -> Column:
    """Components as whole numbers below their multiple by scale; null where one is null or not finite."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    odd = F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~odd, F.transform(wide, lambda x: F.floor(x * scale)))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, vector) of the rows that take part, one for each id."""
    squares = F.aggregate(F.col("vector"), F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()) & (squares < 2.0**60)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("vector").cast("array<long>").alias("vector")).where(good)
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row")).select("vec_id", "row.*")


def matrix(column: pa.ChunkedArray, rows: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for row, v in zip(out, column.take(pa.array(rows)).to_pylist(), strict=True):
        row[: len(v)] = v
    return out


def tiles(batches):
    """(table, rows of its anchors, rows of its candidates by id, [anchor, candidate] scores) of each pair of blocks."""
    for t in grouped(batches, ["key", "bi", "bj"]):
        side, ids = t["side"].to_numpy(), t["vec_id"].to_numpy()
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if len(one) and len(two):
            two = two[np.argsort(ids[two])]
            width = max(len(v) for v in t["vector"])
            yield t, one, two, strassen(matrix(t["vector"], one, width), matrix(t["vector"], two, width).T)


def downwards(scores: np.ndarray) -> np.ndarray:
    """Each row's places by falling score, equal ones in their order; what has the least number comes last."""
    return np.argsort(np.where(scores == _LEAST, np.iinfo(np.int64).max, -scores), axis=1, kind="stable")


def dealt(rows: DataFrame, anchor: Column, key: Column, block: int) -> DataFrame:
    """rows by blocks of anchors (side 0) and of all rows (side 1) with the same key."""
    return in_blocks(rows.withColumns({"key": key, "entry": F.col("vec_id")}), "key", anchor, F.lit(True), block)


def first(lists: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rows by score and id of each key, with their rank. Spark cuts each task's rows to n of a key before the shuffle."""
    by = Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id")
    return lists.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


def positives(rows: DataFrame, anchor: Column, n: int, block: int) -> DataFrame:
    """(anchor_id, other_id, score, rank): the n other rows of an anchor's label with the highest scores."""

    def best(batches):
        for t, one, two, scores in tiles(batches):
            ids, label = t["vec_id"].to_numpy(), t["label"].to_numpy(zero_copy_only=False)
            scores[(label[one][:, None] != label[two][None, :]) | (ids[one][:, None] == ids[two][None, :])] = _LEAST
            order = downwards(scores)[:, :n]
            found = np.take_along_axis(scores, order, axis=1)
            good = found != _LEAST
            yield listed([np.repeat(ids[one], good.sum(axis=1)), ids[two][order][good], found[good]], ["anchor_id", "other_id", "score"])

    near = dealt(rows, anchor, F.xxhash64("label"), block).mapInArrow(best, "anchor_id long, other_id long, score long")
    return first(near, ["anchor_id"], n)


def listed(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names)


def negatives(rows: DataFrame, wanted: DataFrame, n: int, low: Fraction, block: int) -> DataFrame:
    """(anchor_id, positive_id, other_id, score, rank) over wanted(vec_id, found): found are an anchor's positives with scores.

    A negative's score lies between the positive's times low and the positive's.
    """
    over, under = low.numerator, low.denominator

    def best(batches):
        for t, one, two, scores in tiles(batches):
            ids, label = t["vec_id"].to_numpy(), t["label"].to_numpy(zero_copy_only=False)
            scores[label[one][:, None] == label[two][None, :]] = _LEAST
            order = downwards(scores)
            down = np.take_along_axis(scores, order, axis=1)
            found = t["found"].take(pa.array(one)).to_pylist()
            a = np.repeat(np.arange(len(one)), [len(f) for f in found])
            positive, top = (np.array([p[name] for f in found for p in f], np.int64) for name in ("other_id", "score"))
            # rows above a window come first, so it begins after as many
            begin = np.array([np.count_nonzero(down[i] > s) for i, s in zip(a, top, strict=True)], np.int64)
            place = begin[:, None] + np.arange(n)
            inside = place < len(two)
            place = np.minimum(place, len(two) - 1)
            score = down[a[:, None], place]
            good = inside & (score != _LEAST)
            good &= np.where(good, score, 0) * under >= top[:, None] * over
            times = good.sum(axis=1)
            yield listed([np.repeat(ids[one][a], times), np.repeat(positive, times), ids[two][order[a[:, None], place]][good], score[good]], ["anchor_id", "positive_id", "other_id", "score"])

    asked = rows.join(wanted, "vec_id", "left")
    near = dealt(asked, F.col("found").isNotNull(), F.lit(0).cast("long"), block).mapInArrow(best, "anchor_id long, positive_id long, other_id long, score long")
    return first(near, ["anchor_id", "positive_id"], n)


def mine(vectors: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 5, low: Fraction = Fraction(4, 5), block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) over vectors(vec_id, label, vector of whole numbers).

    anchor: which rows are anchors, of vec_id and label. low: a negative's least share of the
    positive's score, with small terms, as scores are multiplied by them.
    """
    if not 0 <= low <= 1 or low.denominator > 7:
        raise ValueError("the window's lower end is a fraction between 0 and 1 with a denominator up to 7")
    rows = keep(usable(vectors), "rows")
    found = keep(positives(rows, anchor, n_positives, block), "positives")
    wanted = found.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("other_id", "score")).alias("found"))  # n_positives at most
    out = negatives(rows, wanted, n_negatives, low, block).withColumnsRenamed({"other_id": "negative_id", "score": "negative_score"})
    scores = found.select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return out.join(scores, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
