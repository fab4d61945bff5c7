"""Pack token streams into windows by minimum bin slack.

Documents are cut into full windows and one rest. Only the number of rests of each length - a
table no longer than the window - goes to the driver, which picks multisets of lengths that fill
a window with the least slack and how often each is used. Pieces find their window by their rank
among pieces of the same length.

Defined cases: a null or empty text is the end id alone; a null id is kept; repeated rows are
packed each; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import keep, shards
from barloom.llm.tokens import encoded

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take with one of the longest so that the least room is left.

    A bitset holds the sums that can be reached; a length's count enters as powers of two, and
    the bitset before each of these steps is kept to read the choice backwards.
    """
    longest = max(counts)
    room = capacity - longest
    taken = {longest: 1}
    reach, trail = 1, []
    full = (1 << (room + 1)) - 1
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left = min(counts[length] - (length == longest), room // length)
        step = 1
        while left > 0:
            step = min(step, left)
            trail.append((length, step, reach))
            reach |= (reach << (length * step)) & full
            left -= step
            step *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    for length, step, before in reversed(trail):
        if not before >> best & 1:
            taken[length] = taken.get(length, 0) + step
            best -= length * step
    return taken


def minimum_slack(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths in a window, windows) until nothing is left; each choice is used as often as counts allow."""
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        chosen = fill(counts, capacity)
        times = min(counts[n] // k for n, k in chosen.items())
        out.append((chosen, times))
        for n, k in chosen.items():
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    return out


def cut(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of every document, with checksums of their ids."""

    def pieces(batches):
        for part, ids, sizes in encoded(batches, tokenizer_path, end_id):
            cuts = -(-sizes // capacity)
            row = np.repeat(np.arange(len(sizes)), cuts)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * capacity
            length = np.minimum(capacity, sizes[row] - start)
            at = (np.cumsum(sizes) - sizes)[row] + start
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[row])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to pieces of at most capacity tokens."""
    spark, n = pieces.sparkSession, shards(pieces.sparkSession)
    pieces = pieces.withColumn("sub", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n)))
    groups = keep(pieces.groupBy("length", "sub").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan, used, base = [], dict.fromkeys(counts, 0), 0
    for chosen, times in minimum_slack(counts, capacity):
        offset = 0
        for length, k in sorted(chosen.items(), reverse=True):
            plan.append((length, used[length], used[length] + k * times, k, base, offset))
            used[length] += k * times
            offset += k * length
        base += times
    slots = spark.createDataFrame(plan, "length long, low long, high long, each long, base long, room long")
    # a length that many pieces have is ranked in parts, and the parts' sizes are added up
    before = groups.select("length", "sub", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "sub").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = pieces.withColumn("inside", F.row_number().over(order) - 1).join(before, ["length", "sub"]).withColumn("rank", F.col("before") + F.col("inside"))
    # slots has a few rows for each length up to capacity, however many documents there are
    placed = ranked.join(F.broadcast(slots), (ranked.length == slots.length) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    nth = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "start", ranked.length, "ids_crc32", "doc_tokens",
        (F.col("base") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("room") + (nth % F.col("each")) * ranked.length).alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048) -> DataFrame:
    """Every id of every document in exactly one window of at most capacity ids."""
    return place(keep(cut(docs, tokenizer_path, end_id, capacity), "pieces"), capacity)
