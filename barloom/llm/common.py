"""Helpers that several corpus operators share: shared storage, word hashing, components."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The blanks between words: space and the five ASCII controls from tab to carriage return.
BLANK = " \t\n\x0b\x0c\r"
#: Stands for a null id: such rows count as one document with the greatest id.
NO_ID = (1 << 63) - 1

_BLANKS = np.zeros(256, bool)
_BLANKS[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes of a word from which it takes a cryptographic hash.
LONG = 64
#: Bytes hashed at once; bounds a worker's arrays to about 40 times this.
CHUNK_BYTES = 1 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and driver and executors are one process (tests, a laptop) a
    temporary folder is set; on a cluster that is an error.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
        base = sc.getCheckpointDir()
    return f"{base}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings for a while."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Settings of jobs that send texts to Python: batches of texts are as large as a worker's steps, no larger.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(2 * CHUNK_BYTES)}


def keep(df: DataFrame, name: str, more: dict[str, str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, one copy of the work.

    Shuffle files of the job are freed at its end, as nothing reads them again. more: settings
    that hold for this job alone.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    with settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"} | BATCHES | (more or {})):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shards(spark: SparkSession) -> int:
    """Groups to deal hashed work into; follows the session's shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """64-bit hashes of the words of many texts at once.

    A word is a run without BLANK bytes, A-Z lower-cased; its hash is a polynomial over its
    bytes, read off running sums, then mixed. Modulo 2**64 such polynomials have long words of equal
    hash for any base, so words of more than LONG bytes take a cryptographic hash instead.
    """

    def __init__(self) -> None:
        self.size = 0

    def _grow(self, n: int) -> None:
        if n > self.size:
            self.size = max(n, CHUNK_BYTES)
            steps = np.full(self.size + 1, _BASE, np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = _INVERSE
            self.down = np.cumprod(steps, dtype=np.uint64)

    def hashes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """data: bytes of all texts; text i is data[offsets[i]:offsets[i+1]].

        Returns the words' hashes in order and, for each text, where its words begin (len + 1).
        """
        n = len(data)
        if n == 0:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        self._grow(n)
        blank = _BLANKS[data]
        cut = np.ones(n + 1, bool)
        cut[1:n] = blank[:-1]
        inner = offsets[(offsets > 0) & (offsets < n)]
        cut[inner] = True
        starts = np.flatnonzero(~blank & cut[:n])
        after = np.ones(n + 1, bool)
        after[1:n] = blank[1:]
        after[inner] = True
        ends = np.flatnonzero(~blank & after[1:]) + 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        raw = (sums[ends] - sums[starts]) * self.down[starts]
        for i in np.flatnonzero(ends - starts > LONG):
            raw[i] = int.from_bytes(hashlib.blake2b(_LOWER[data[starts[i] : ends[i]]].tobytes(), digest_size=8).digest(), "little")
        return mix64(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(40))), np.searchsorted(starts, offsets)


def text_chunks(column: pa.Array):
    """Yield (first row, end row, bytes, offsets) over a string column, at most CHUNK_BYTES or one text each."""
    column = column.fill_null("") if column.null_count else column
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def pack(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values as byte planes of their steps, compressed."""
    steps = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def squeeze(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def unsqueeze(blob: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype)


def fixed_bitmap(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits over the 64-bit hashes in a column, one bit each.

    Its size is fixed whatever the table's, so it may be sent to all; with more rows it only
    lets more through, and what it lets through is joined exactly afterwards.
    """
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    rows = (
        df.select(F.shiftright(place, 6).cast("int").alias("word"), F.expr("1L").alias("one"), (place % 64).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(one, bit))").alias("bits"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64) if rows.num_rows else 0
    return out


def bitmap_hits(bitmap: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    place = values >> np.uint64(64 - bits)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) != 0


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b); component: the smallest node reachable.

    Alternates two star rewirings until nothing changes: first every node's larger neighbours
    move to its smallest one, then its smaller ones. Each step is a minimum by key (combined
    before the shuffle) joined back, so a node with many neighbours is never gathered.
    """
    links = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    for _ in range(rounds):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        up = large.distinct()
        least = up.groupBy("a").agg(F.min("b").alias("low"))
        small = up.join(least, "a")
        links = keep(small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(least.select("a", F.col("low").alias("b"))).distinct(), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
