"""Near-duplicate vectors by E8 lattice hashing.

Each of a few tables projects the unit vectors to eight random dimensions and decodes them to the
nearest point of the E8 lattice. A vector is stored in the cell of its point and looks, besides
its own, into the neighbouring cells that lie nearest. What meets in a cell is compared by cosine
in double precision. Equal vectors are one entry with a count.

A cell gives each vector that has a match one edge to the smallest of the vectors it is joined
with there, so edges grow with vectors, not pairs. Links are then counted inside the components,
which hold every link found. Cells and components of many vectors are dealt into a grid of blocks,
each a task's work of bounded size: nothing is capped.

Defined cases: a vector that is null, empty, zero or holds a null or a non-finite number, or a null
label, links with nothing; vectors of different lengths never meet; a null id is kept and never
names a component unless all ids of it are null; repeated rows are equal vectors, each one linked
with the others; other columns are ignored; an empty table is fine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import components, keep

#: Tables, neighbouring cells each vector looks into, and the step of the lattice; together they
#: find a pair at cosine 0.93 with probability over 0.995.
TABLES, PROBES, SCALE = 3, 6, 0.55
#: Vectors compared at once: a task's matrix is at most BLOCK x BLOCK.
BLOCK = 1000


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of one, or all of one half with an even number below zero."""
    pairs = [a * np.eye(8)[i] + b * np.eye(8)[j] for i in range(8) for j in range(i) for a in (1, -1) for b in (1, -1)]
    signs = np.array([[1 - 2 * (k >> i & 1) for i in range(8)] for k in range(256)])
    return np.concatenate([pairs, signs[signs.prod(axis=1) > 0] / 2])


def nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest whole-number points with an even sum: where it is odd, the worst entry rounds the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(axis=1) % 2)
    worst = np.abs(off[odd]).argmax(axis=1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return near


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, the even points and those moved by one half."""
    whole, half = nearest_even(x), nearest_even(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.where(closer[:, None], whole, half)


def projections(size: int, tables: int, scale: float, seed: int) -> list[np.ndarray]:
    return [np.random.default_rng([seed, size, t]).normal(size=(size, 8)) * scale for t in range(tables)]


def signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def entries(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, entry, vector bytes) of every row; entry is null where a row links with nothing."""

    def rows(batches):
        for b in batches:
            names, data = [], []
            for v, label in zip(b.column("embedding").to_pylist(), b.column("label").to_pylist(), strict=True):
                x = np.array(v if v is not None else [], np.float64)  # a null entry becomes nan
                good = label is not None and len(x) and np.isfinite(x).all() and np.abs(x).max() > 0
                raw = x.astype("<f8").tobytes()
                names.append(signed(xxhash.xxh3_64_intdigest(raw + str(label).encode())) if good else None)
                data.append(raw if good else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label").cast(pa.string()), pa.array(names, pa.int64()), pa.array(data, pa.binary())], ["vec_id", "label", "entry", "vector"])

    return vectors.mapInArrow(rows, "vec_id long, label string, entry long, vector binary")


def units(raw: list[bytes]) -> np.ndarray:
    """Unit rows; scaled by the largest entry first, so that squares neither overflow nor vanish."""
    x = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cells(distinct: DataFrame, tables: int, probes: int, scale: float, seed: int) -> DataFrame:
    """(cell, home, entry, vector): each entry's own cells, and those it looks into."""

    def rows(batches):
        around = roots()
        for b in batches:
            raw = b.column("vector").to_pylist()
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                unit = units([raw[i] for i in rows])
                label = np.array([xxhash.xxh3_64_intdigest(b.column("label")[int(i)].as_py().encode()) for i in rows], np.uint64)
                for t, matrix in enumerate(projections(int(size) // 8, tables, scale, seed)):
                    point = unit @ matrix
                    home = nearest_point(point)
                    order = np.argpartition(-((point - home) @ around.T), probes, axis=1)[:, :probes]
                    look = np.concatenate([home[:, None], home[:, None] + around[order]], axis=1)
                    doubled = np.rint(look * 2).astype(np.int32)
                    for i, row in enumerate(rows):
                        salt = int(label[i]) ^ (t << 8) ^ int(size)
                        ids = [signed(xxhash.xxh3_64_intdigest(p.tobytes(), seed=salt)) for p in doubled[i]]
                        yield ids, int(row)

    def batched(batches):
        for b in batches:
            for part in (b.slice(i, 512) for i in range(0, b.num_rows, 512)):
                cell, home, at = [], [], []
                for ids, row in rows([part]):
                    cell += [ids[0], *ids]
                    home += [True] + [False] * len(ids)
                    at += [row] * (len(ids) + 1)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(home), part.column("entry").take(take), part.column("vector").take(take)], ["cell", "home", "entry", "vector"])

    return distinct.select("label", "entry", "vector").mapInArrow(batched, "cell long, home boolean, entry long, vector binary")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The groups of rows sorted by keys, across batch ends."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        values = np.stack([b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys])
        cut = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        edges = [0, *cut.tolist(), b.num_rows]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            now = tuple(values[:, i].tolist())
            if held and now != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
            last = now
    if held:
        yield pa.Table.from_batches(held)


def in_blocks(rows: DataFrame, key: str, left, right, block: int) -> DataFrame:
    """rows of each key dealt to a grid: side 0 by block row, side 1 by block column, sorted for grouped()."""
    sizes = rows.groupBy(key).agg(F.count(F.when(left, 1)).alias("lefts"), F.count(F.when(right, 1)).alias("rights")).where("lefts > 0 and rights > 0")
    sizes = sizes.select(key, F.ceil(F.col("lefts") / block).cast("int").alias("bl"), F.ceil(F.col("rights") / block).cast("int").alias("br"))
    rows = rows.join(sizes.hint("rebalance"), key)
    spot = F.xxhash64("entry", F.lit(7))

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    one = rows.where(left).withColumn("bi", F.pmod(spot, "bl").cast("int")).withColumn("bj", every("br")).withColumn("side", F.lit(0))
    two = rows.where(right).withColumn("bj", F.pmod(spot, "br").cast("int")).withColumn("bi", every("bl")).withColumn("side", F.lit(1))
    both = one.union(two.select(one.columns)).drop("bl", "br")
    return both.repartition(key, "bi", "bj").sortWithinPartitions(key, "bi", "bj")


def joined(match: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest entry that each row and column of a match matrix is joined with, directly or on."""
    a, b = low.copy(), high.copy()
    top = np.iinfo(np.int64).max
    while True:
        na = np.minimum(a, np.where(match, b[None, :], top).min(axis=1, initial=top))
        nb = np.minimum(b, np.where(match, na[:, None], top).min(axis=0, initial=top))
        if (na == a).all() and (nb == b).all():
            return a, b
        a, b = na, nb


def edges(found: DataFrame, cosine: float, block: int) -> DataFrame:
    """Edges (a, b) that join the entries matching in a cell."""

    def match(batches):
        for t in grouped(batches, ["cell", "bi", "bj"]):
            side = t["side"].to_numpy()
            if side.min() == side.max():
                continue
            entry, unit = t["entry"].to_numpy(), units(t["vector"].to_pylist())
            homes, looks = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            near = unit[homes] @ unit[looks].T >= cosine
            a, b = joined(near, entry[homes], entry[looks])
            ends, to = np.concatenate([entry[homes], entry[looks]]), np.concatenate([a, b])
            some = ends != to
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(ends[some]), pa.array(to[some])], ["a", "b"])

    return in_blocks(found, "cell", F.col("home"), ~F.col("home"), block).mapInArrow(match, "a long, b long").distinct()


def degrees(members: DataFrame, cosine: float, block: int) -> DataFrame:
    """(entry, links) over members(component, entry, vector, copies): vectors of other entries linked with each."""

    def count(batches):
        for t in grouped(batches, ["component", "bi", "bj"]):
            side = t["side"].to_numpy()
            if side.min() == side.max():
                continue
            entry, copies, unit = t["entry"].to_numpy(), t["copies"].to_numpy(), units(t["vector"].to_pylist())
            one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            near = (unit[one] @ unit[two].T >= cosine) & (entry[one][:, None] != entry[two][None, :])
            yield pa.RecordBatch.from_arrays([pa.array(entry[one]), pa.array(near @ copies[two].astype(np.int64))], ["entry", "links"])

    all_rows = F.lit(True)
    parts = in_blocks(members, "component", all_rows, all_rows, block).mapInArrow(count, "entry long, links long")
    return parts.groupBy("entry").agg(F.sum("links").alias("links"))


def near_vectors(vectors: DataFrame, cosine: float = 0.93, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE, seed: int = 5, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors(vec_id, embedding, label)."""
    rows = keep(entries(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")), "vectors")
    good = rows.where("entry is not null")
    distinct = keep(good.groupBy("entry").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.min("label").alias("label"), F.min("vector").alias("vector")), "entries")
    parts = keep(components(edges(cells(distinct, tables, probes, scale, seed), cosine, block)), "components")
    members = parts.withColumnRenamed("node", "entry").join(distinct.select("entry", "vector", "copies"), "entry").select("component", "entry", "vector", "copies")
    links = degrees(members, cosine, block)
    named = distinct.select("entry", "first", "copies").join(parts.toDF("entry", "component"), "entry", "left").withColumn("component", F.coalesce("component", "entry"))
    named = named.join(named.groupBy("component").agg(F.min("first").alias("component_id")), "component").join(links, "entry", "left")
    named = keep(named.select("entry", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "named")
    out = rows.join(named.hint("rebalance"), "entry", "left")
    component = F.when(F.col("entry").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
