"""Stupid-backoff scores of documents, computed relationally.

Texts are exploded into n-grams, each a context (the words before) and a word. Count tables of pairs
and of contexts are grouped from them, joined back on (context, word) and on context, and the
logarithms are summed per document: S(w | u v) = c(u v w) / c(u v) if the n-gram was seen, else
alpha S(w | v), and at last c(w) / N.

`score_documents` scores a corpus by its own counts. There every n-gram has been seen, so the first
order - 1 words of a document come to c(u v) / N, as the counts between cancel, and only two
count tables are needed: n-grams are dealt by the hash of their context, both tables are grouped and
joined where the n-grams lie, and one more shuffle sums up documents. The n-grams are handled in
`rounds` parts by their context's hash, one after another, and shuffle files are freed in between, so
they take a fraction of the disk. Contexts above a thousandth of all words are
left out of that and go by plain joins on (context, word), whose hot keys Spark splits.

`score_against` scores documents by the counts of another corpus and backs off where it must.

Words are hashed to 64 bits, A-Z as a-z; n-grams mix their words' hashes.

Defined cases: a null, empty or blank text has no words, a score of 0 and a null mean; texts of
fewer than order - 1 words score the count of the whole text by N; repeated rows count as often as
they stand and score alike; a null id is kept; other columns are ignored; an empty table gives an
empty table. In `score_against` a word that the corpus lacks counts one half.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import WordHasher, keep, mix64, shards, text_chunks

ALPHA = 0.4
#: N-grams of a round in one partition.
ROWS = 2_000_000
#: Stand for no word: a document's first context, and the end behind its last one. Words are even.
FIRST, END = 1, 3


@lru_cache(maxsize=1)
def hasher() -> WordHasher:
    return WordHasher()


def grams_of(words: np.ndarray, sizes: np.ndarray, order: int) -> list[np.ndarray]:
    """For 1 to order: the hash of the n-gram that ends at each word; the first n - 1 of a text are of no use."""
    out, gram = [], mix64(words)
    for n in range(1, order + 1):
        if n > 1:
            gram = mix64(np.concatenate([gram[:1], gram[:-1]]) * np.uint64(0x9E3779B97F4A7C15) + words + np.uint64(n))
        out.append(gram)
    return out


def read(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(rows, words in each, words' hashes, places in their texts, n-grams) of slices of a few megabytes."""
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch.column("text")):
            words, bounds = hasher().hashes(data, offsets)
            sizes = np.diff(bounds)
            place = np.arange(len(words)) - np.repeat(bounds[:-1], sizes)
            yield batch.slice(i, j - i), sizes, words & ~np.uint64(1), place, grams_of(words, sizes, order)


def counted(keys: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """(places, counts): where each different row of columns stands first, in order, and how often it stands."""
    for c in columns:
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) ^ c)
    _, at, n = np.unique(keys, return_index=True, return_counts=True)
    back = np.argsort(at)
    return at[back], n[back]


def rows_of(names: str, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64) if isinstance(a, np.ndarray) and a.dtype == np.uint64 else a) for a in arrays], names.split())


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, d, text); d names a text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("d"), text.alias("text"))


def sized(texts: DataFrame, order: int, share: int) -> DataFrame:
    """Rows (doc_id, d, n_words) of all documents, and rows (ctx, n) of contexts that are frequent in a slice: at most 2 * share of each."""

    def rows(batches):
        for part, sizes, _, place, grams in read(batches, max(order - 1, 1)):
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("d"), pa.array(sizes), none, none], ["doc_id", "d", "n_words", "ctx", "n"])
            ctx, n = np.unique(grams[order - 2][place >= order - 2], return_counts=True)
            many = n * 2 * share > len(place)
            if many.any():
                none = pa.nulls(int(many.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, none, pa.array(ctx[many].view(np.int64)), pa.array(n[many])], ["doc_id", "d", "n_words", "ctx", "n"])

    return texts.mapInArrow(rows, "doc_id long, d long, n_words long, ctx long, n long")


def exploded(texts: DataFrame, order: int, heavy: np.ndarray, rounds: int, part: int | None) -> DataFrame:
    """(ctx, w, d, tf): the n-grams of every document with counts, for one part of the contexts or the frequent ones (None).

    A document's first context comes once more with FIRST, which isn't counted, its last one with END.
    """

    def rows(batches):
        for batch, sizes, words, place, grams in read(batches, order - 1):
            ctx = grams[order - 2]
            often = np.isin(ctx, heavy)
            mine = (often if part is None else ~often & (ctx % np.uint64(rounds) == np.uint64(part))) & (place >= order - 2)
            last = np.zeros(len(words) + 1, bool)
            last[np.cumsum(sizes)] = True
            # the place of each context's last word, and what comes behind it
            at, first = np.flatnonzero(mine), np.flatnonzero(mine & (place == order - 2))
            behind = np.where(last[at + 1], np.uint64(END), np.concatenate([words, [np.uint64(END)]])[at + 1])
            doc = np.repeat(np.asarray(batch.column("d")).view(np.uint64), sizes)
            at = np.concatenate([at, first])
            c, w, d = ctx[at], np.concatenate([behind, np.full(len(first), FIRST, np.uint64)]), doc[at]
            at, tf = counted(d, c, w)
            if len(at):
                yield rows_of("ctx w d tf", c[at], w[at], d[at], tf.astype(np.int32))

    return texts.select("d", "text").mapInArrow(rows, "ctx long, w long, d long, tf int")


#: The sum of each document's logarithms over its n-grams. The n-grams are asked for several times
#: but computed and shuffled once: to the planner the filter has no fixed result, so it shares them.
GAINS = f"""
WITH grams AS (SELECT {{deal}} ctx, w, d, tf FROM {{rows}} WHERE spark_partition_id() >= 0),
pairs AS (SELECT ctx, w, sum(if(w = {FIRST}, 0, tf)) AS n, count(*) AS parts FROM grams GROUP BY ctx, w),
contexts AS (SELECT ctx, sum(if(w = {FIRST}, 0, tf)) AS total, count(*) AS parts FROM grams GROUP BY ctx)
SELECT {{hints}} d, sum(CASE g.w WHEN {FIRST} THEN tf * ln(coalesce(total, tf)) WHEN {END} THEN 0 ELSE tf * (ln(coalesce(n, tf)) - ln(coalesce(total, tf))) END) AS s
FROM grams g LEFT JOIN contexts c ON c.ctx = g.ctx AND c.parts > 1 LEFT JOIN pairs p ON p.ctx = g.ctx AND p.w = g.w AND p.parts > 1
GROUP BY d
"""


def gains(rows: DataFrame, parts: int) -> DataFrame:
    """(d, s) of rows(ctx, w, d, tf); in `parts` partitions by the hash of their context, or (0) by plain joins, whose hot keys Spark splits.

    What stands in one row alone needs no table: its count is its own.
    """
    deal = f"/*+ REPARTITION({parts}, ctx) */" if parts else ""
    # frequent contexts are 2 * share rows at most
    hints = "/*+ SHUFFLE_HASH(c), SHUFFLE_HASH(p) */" if parts else "/*+ BROADCAST(c) */"
    return rows.sparkSession.sql(GAINS.format(deal=deal, hints=hints, rows="{rows}"), rows=rows)


def short_gains(texts: DataFrame, k: int) -> DataFrame:
    """(d, s): log counts of whole texts of k words."""

    def rows(batches):
        for batch, sizes, _, place, grams in read(batches, k):
            g, n = np.unique(grams[k - 1][place >= k - 1], return_counts=True)
            ends = np.cumsum(sizes)[sizes == k] - 1
            whole = pa.array(np.asarray(batch.column("d"))[sizes == k])
            yield rows_of("g n d", np.concatenate([g, grams[k - 1][ends]]), np.concatenate([n, np.zeros(len(ends), np.int64)]), pa.concat_arrays([pa.nulls(len(g), pa.int64()), whole]))

    found = texts.select("d", "text").mapInArrow(rows, "g long, n long, d long")
    wanted = found.where("d IS NOT NULL").groupBy("g", "d").agg(F.count("*").alias("copies"))
    counts = found.where("d IS NULL").groupBy("g").agg(F.sum("n").alias("n"))
    return wanted.join(counts, "g").groupBy("d").agg(F.sum(F.col("copies") * F.log("n")).alias("s"))


def finished(sizes: DataFrame, sums: list[DataFrame], shift: float) -> DataFrame:
    """Documents with the sum of their parts' (d, s) less shift; equal texts share theirs."""
    each = reduce(DataFrame.unionByName, [s.withColumn("copies", F.lit(0)) for s in sums], sizes.select("d", F.lit(0.0).alias("s"), F.lit(1).alias("copies")))
    scores = keep(each.groupBy("d").agg((F.sum("s") / F.sum("copies")).alias("s")), "scores")
    out = sizes.join(scores, "d").select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.col("s") - shift).otherwise(F.lit(0.0)).alias("log_score"))
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def score_documents(docs: DataFrame, order: int = 3, rounds: int = 3, share: int = 1_000) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every row of docs(doc_id, text) by the counts of all of them."""
    if order < 2:
        raise ValueError("order starts at 2")
    texts = keyed(docs)
    known = keep(sized(texts, order, share), "sizes")
    sizes = known.where("d IS NOT NULL").select("doc_id", "d", "n_words")
    everything = sizes.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    # counts of all slices add up to no more than everything, so 2 * share contexts at most are left
    often = known.where("ctx IS NOT NULL").groupBy("ctx").agg(F.sum("n").alias("n")).where(F.col("n") * 2 * share > everything)
    heavy = np.sort(often.select("ctx").toArrow()["ctx"].to_numpy().view(np.uint64))
    parts = max(shards(docs.sparkSession), -(-everything // rounds // ROWS))
    # the n-grams of a context lie together already, whatever else the keys of a join hold
    together = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}
    sums = [keep(gains(exploded(texts, order, heavy, rounds, part), parts), "gains", together) for part in range(rounds)]
    sums.append(keep(gains(exploded(texts, order, heavy, rounds, None), 0), "gains"))
    sums += [keep(short_gains(texts, k), "gains") for k in range(1, order - 1)]
    return finished(sizes, sums, math.log(max(everything, 1)))


def score_against(docs: DataFrame, corpus: DataFrame, order: int = 3, alpha: float = ALPHA) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every row of docs by the counts of corpus, with backoff."""

    def count_rows(batches):
        for _, _, _, place, grams in read(batches, order):
            for n, g in enumerate(grams):
                names, counts = np.unique(g[place >= n], return_counts=True)
                if len(names):
                    yield rows_of("g n", names, counts)

    names = ["d", "depth", *[f"{x}{n}" for n in range(1, order + 1) for x in ("g", "c")]]

    def asked(batches):
        """The n-grams that end at each word and those that end before it."""
        for batch, sizes, _, place, grams in read(batches, order):
            doc = np.repeat(np.asarray(batch.column("d")), sizes)
            columns = [pa.array(doc), pa.array(np.minimum(place, order - 1))]
            for n, g in enumerate(grams):
                columns += [pa.array(g.view(np.int64), mask=place < n), pa.array(np.concatenate([g[:1], g[:-1]]).view(np.int64), mask=place < n + 1)]
            yield pa.RecordBatch.from_arrays(columns, names)

    counts = corpus.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count_rows, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    counts = keep(counts, "counts")
    everything = max(keep(sized(keyed(corpus.withColumn("doc_id", F.lit(0))), order, 1), "words").agg(F.sum("n_words")).first()[0] or 0, 1)
    texts = keyed(docs)
    rows = texts.select("d", "text").mapInArrow(asked, ", ".join(f"{n} long" for n in names)).groupBy(*names).agg(F.count("*").alias("tf"))
    for name in names[2:-1]:
        rows = rows.join(counts.select(F.col("g").alias(name), F.col("n").alias(f"n_{name}")), name, "left").drop(name)
    score = F.log(F.coalesce(F.col("n_g1"), F.lit(0.5)) / everything)
    for n in range(2, order + 1):
        back = F.when(F.col("depth") >= n - 1, score + math.log(alpha)).otherwise(score)
        score = F.when(F.col(f"n_g{n}").isNotNull(), F.log(F.col(f"n_g{n}") / F.col(f"n_c{n - 1}"))).otherwise(back)
    sums = keep(rows.select("d", (F.col("tf") * score).alias("s")).groupBy("d").agg(F.sum("s").alias("s")), "gains")
    sizes = keep(sized(texts, order, 1).where("d IS NOT NULL").select("doc_id", "d", "n_words"), "sizes")
    return finished(sizes, [sums], 0.0)
