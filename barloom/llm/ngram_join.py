"""N-gram Jaccard join: link documents whose sets of word n-grams overlap enough.

A document is the set of hashes of its n-grams; equal sets are one node from there on. All
n-grams have one order, rare ones first. Two sets that overlap enough share an n-gram among the
first few of both (their prefixes), so only prefixes are indexed:

* rare n-grams (in fewer than ``rare`` sets) one by one, those of one set before those of more;
* frequent ones as pairs. They are dealt into g parts by hash and a prefix is longer by g, so two
  similar sets share g + 1 of its n-grams, hence a rare one or two of one part. g follows the
  set's size (a power of two); a set is indexed for its own size and, where a similar set may be
  of the next, for that too. Pairs are few: g parts of about five n-grams each.

An n-gram's class, the doublings of its count, is read from a table of fixed size, counted over all
documents. It is the same for everyone, so any content gives the same links; it only moves work.

Candidates are verified on the sets themselves. Posting lists of rare n-grams are shorter than
``rare``. In a longer list every set is first compared with one centre, which joins a group of
copies whatever its size by as many comparisons as it has members. Lists of one component are
done; in the others only sets of different components are compared, and of these only the pairs
that sizes, frequent n-grams, parity sketches and the triangle inequality leave possible. No link is given up: what
is skipped can't be one, or lies within a component.

Defined cases: a null, empty or blank text has the empty set and links with nothing; a text of
fewer words than n is one n-gram; a null id is kept and never names a component unless all ids of
it are null; repeated rows are equal sets; other columns are ignored; an empty table is fine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import BATCHES, WordHasher, bitmap_hits, components, fixed_bitmap, keep, mix64, pack, settings, shards, squeeze, text_chunks, unpack, unsqueeze
from barloom.llm.tokens import forget

#: An n-gram in this many sets or more is frequent (a power of two).
RARE = 16
#: Longer posting lists are dealt into blocks of this many sets.
BLOCK = 1000
#: The table of n-grams' classes has 2**TABLE_BITS bytes and is sent to all.
TABLE_BITS = 25
#: At most so many n-grams have a class above 0; beyond, all limits double until that holds.
CLASSED_MOST = 1 << 24
#: 64-bit words of a set's parity sketch.
SKETCH = [f"s{i}" for i in range(8)]
#: Bits of the map of candidate sets.
MAP_BITS = 26
#: N-grams a task gathers before it writes them out; sorting and packing them takes some 50 bytes for each.
GATHER = 1 << 20


def sets_of(batches: Iterator[pa.RecordBatch], n: int, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of rows with the sorted distinct n-gram hashes of each."""
    forget()
    hasher = WordHasher()
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch.column(column)):
            words, bounds = hasher.hashes(data, offsets)
            grams = words.copy()
            if len(words) >= n:
                grams = words[: len(words) - n + 1]
                for k in range(1, n):
                    grams = mix64(grams * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
            out = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a >= n:
                    out.append(np.unique(grams[a : b - n + 1]))
                elif b > a:
                    out.append(np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes())], np.uint64))
                else:
                    out.append(words[:0])
            yield batch.slice(i, j - i), out


def set_id(grams: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    v = xxhash.xxh3_64_intdigest(grams.tobytes())
    return v - (1 << 64) if v >> 63 else v


def sketch_of(grams: np.ndarray) -> np.ndarray:
    """For each of 512 places, whether an odd number of the set's n-grams falls there.

    Places where two sketches differ are at most as many as n-grams of one set only, which bounds
    the overlap of two sets from above.
    """
    odd = np.bincount((grams & np.uint64(511)).astype(np.int64), minlength=512).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64)


def least_overlap(size: int, percent: int) -> int:
    """The fewest n-grams that a set of this size shares with any set linked to it."""
    return -(-percent * size // 100)


def level_parts(size: int, percent: int) -> int:
    """Parts for pairs at the level (a power of two) of a size."""
    level = 1 << (size.bit_length() - 1)
    return max(1, (2 * level * (100 - percent) // 100) // 4)


def describe(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, set_id, n_shingles) of every row; set_id is null for an empty set."""

    def rows(batches):
        for part, sets in sets_of(batches, n):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "set_id", "n_shingles"]
            )

    return docs.mapInArrow(rows, "doc_id long, set_id long, n_shingles long")


def class_table(docs: DataFrame, n: int):
    """A byte for each of 2**TABLE_BITS places of hashes: the doublings of the count of its most frequent n-gram.

    Tasks send counts of n-grams cut to 40 bits, once for each set they meet; every group covers a
    range of hashes and gives its part of the table. 0 stands for n-grams of one set.
    """
    spark, groups = docs.sparkSession, shards(docs.sparkSession)

    def gather(batches):
        seen: set[int] = set()
        held, size = [], 0

        def flush():
            grams, counts = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(grams, (np.arange(groups + 1, dtype=object) * (1 << 64) // groups)[1:-1].astype(np.uint64)) if groups > 1 else np.zeros(0, np.int64)
            names, blobs, many = [], [], []
            for g, (x, c) in enumerate(zip(np.split(grams, cut), np.split(counts, cut), strict=True)):
                if len(x):
                    names.append(g)
                    blobs.append(pack(np.unique(x >> np.uint64(24))))
                    # counts over one within the task, by place; most are one and need no word
                    twice = c > 1
                    many.append(squeeze(np.concatenate([x[twice] >> np.uint64(24), c[twice].astype(np.uint64) - np.uint64(1)])))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary()), pa.array(many, pa.binary())], ["grp", "grams", "more"])

        for _, sets in sets_of(batches, n):
            for s in sets:
                if len(s) and (name := set_id(s)) not in seen:
                    if len(seen) < 200_000:
                        seen.add(name)
                    held.append(s)
                    size += len(s)
                    if size >= GATHER:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    def count(t: pa.Table) -> pa.Table:
        grams = np.concatenate([unpack(b) for b in t["grams"].to_pylist()])
        more = [unsqueeze(b, np.uint64) for b in t["more"].to_pylist()]
        names, counts = np.unique(grams, return_counts=True)
        np.add.at(counts, np.searchsorted(names, np.concatenate([m[: len(m) // 2] for m in more])), np.concatenate([m[len(m) // 2 :] for m in more]).astype(np.int64))
        names, counts = names[counts > 1], counts[counts > 1]
        kind = np.log2(counts).astype(np.uint8)
        place = (names >> np.uint64(40 - TABLE_BITS)).astype(np.int64)
        first = int(place.min(initial=(1 << TABLE_BITS) - 1))
        part = np.zeros(int(place.max(initial=first)) - first + 1, np.uint8)
        np.maximum.at(part, place - first, kind)
        return pa.table({"first": [first], "part": [squeeze(part)], "kinds": [np.bincount(kind, minlength=64).tolist()]})

    blobs = docs.mapInArrow(gather, "grp int, grams binary, more binary")
    with settings(spark, BATCHES):
        parts = blobs.groupBy("grp").applyInArrow(count, "first long, part binary, kinds array<long>").toArrow()  # the table in parts
    table, kinds = np.zeros(1 << TABLE_BITS, np.uint8), np.zeros(64, np.int64)
    for first, part, k in zip(parts["first"].to_pylist(), parts["part"].to_pylist(), parts["kinds"].to_pylist(), strict=True):
        part = unsqueeze(part, np.uint8)
        np.maximum(table[first : first + len(part)], part, out=table[first : first + len(part)])
        kinds += np.array(k)
    least = 0
    while kinds[least + 1 :].sum() > CLASSED_MOST:
        least += 1
    np.maximum(table, least, out=table)
    table -= np.uint8(least)
    return spark.sparkContext.broadcast(table)


def prefixes(grams: np.ndarray, table: np.ndarray, percent: int, often: int) -> tuple[np.ndarray, np.ndarray]:
    """(single n-grams, pair keys) that index a set; n-grams of the class `often` and above are frequent."""
    size = len(grams)
    base = size - least_overlap(size, percent) + 1
    kind = table[(grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
    order = np.argsort((kind.astype(np.uint64) << np.uint64(58)) | (grams >> np.uint64(6)), kind="stable")
    if kind[order[base - 1]] < often:  # the prefix holds rare n-grams only
        return grams[order[:base]], grams[:0]
    levels = {level_parts(size, percent), level_parts(max(size, size * 100 // percent), percent)}
    prefix = grams[order[: base + max(levels)]]
    inside = kind[order[: base + max(levels)]]
    pairs = []
    for parts in levels:
        frequent = prefix[: base + parts][inside[: base + parts] >= often]
        part = mix64(frequent + np.uint64(parts)) % np.uint64(parts)
        by = np.lexsort((frequent, part))
        frequent, part = frequent[by], part[by]
        for step in range(1, len(frequent)):
            same = part[step:] == part[:-step]
            if not same.any():
                break
            pairs.append(mix64(mix64(frequent[:-step][same]) + frequent[step:][same] + np.uint64(parts)))
    return prefix[:base][inside[:base] < often], np.unique(np.concatenate(pairs)) if pairs else grams[:0]


def rare_candidates(docs: DataFrame, n: int, percent: int, table, often: int) -> DataFrame:
    """Distinct pairs (a, b), a < b, of sets that share a rare n-gram in their prefixes."""
    groups = shards(docs.sparkSession)

    def gather(batches):
        seen: set[int] = set()
        held: list[np.ndarray] = []
        names: list[int] = []
        total: list[int] = []

        def flush():
            grams = np.concatenate(held)
            owner = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for x in held])
            order = np.argsort(grams, kind="stable")
            grams, owner = grams[order], owner[order]
            group = (grams >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)
            cut = np.searchsorted(group, np.arange(1, groups, dtype=np.uint64))
            sets, sizes = np.array(names, np.int64), np.array(total, np.int64)
            out = []
            for g, (x, o) in enumerate(zip(np.split(grams, cut), np.split(owner, cut), strict=True)):
                if len(x):
                    used, o = np.unique(o, return_inverse=True)
                    out.append((g, pack(x), squeeze(o.astype(np.uint32).view(np.uint8).reshape(-1, 4).T), squeeze(np.stack([sets[used], sizes[used]]))))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["grp", "grams", "owner", "sets"])

        size = 0
        for _, sets in sets_of(batches, n):
            for s in sets:
                if len(s) and (name := set_id(s)) not in seen:
                    if len(seen) < 200_000:
                        seen.add(name)
                    single = prefixes(s, table.value, percent, often)[0]
                    if len(single):
                        held.append(single)
                        names.append(name)
                        total.append(len(s))
                        size += len(single)
                        if size >= GATHER:
                            yield flush()
                            held, names, total, size = [], [], [], 0
        if held:
            yield flush()

    def meet(t: pa.Table) -> pa.Table:
        grams, sets, sizes = [], [], []
        for g, o, s in zip(t["grams"].to_pylist(), t["owner"].to_pylist(), t["sets"].to_pylist(), strict=True):
            grams.append(unpack(g))
            owner = np.ascontiguousarray(unsqueeze(o, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()
            both = unsqueeze(s, np.int64).reshape(2, -1)[:, owner]
            sets.append(both[0])
            sizes.append(both[1])
        grams, sets, sizes = np.concatenate(grams), np.concatenate(sets), np.concatenate(sizes)
        order = np.argsort(grams, kind="stable")
        grams, sets, sizes = grams[order], sets[order], sizes[order]
        again = np.concatenate([[False], grams[1:] == grams[:-1], [False]])
        shared = again[:-1] | again[1:]
        grams, sets, sizes = grams[shared], sets[shared], sizes[shared]
        order = np.lexsort((sets, grams))
        grams, sets, sizes = grams[order], sets[order], sizes[order]
        first = np.concatenate([[True], (grams[1:] != grams[:-1]) | (sets[1:] != sets[:-1])])[: len(grams)]
        grams, sets, sizes = grams[first], sets[first], sizes[first]
        found = []
        step = 1
        while step < len(grams):
            near = grams[step:] == grams[:-step]
            if not near.any():
                break
            near &= 100 * np.minimum(sizes[step:], sizes[:-step]) >= percent * np.maximum(sizes[step:], sizes[:-step])
            found.append(np.unique(np.stack([sets[:-step][near], sets[step:][near]], axis=1), axis=0))
            step += 1
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    blobs = docs.mapInArrow(gather, "grp int, grams binary, owner binary, sets binary")
    return blobs.groupBy("grp").applyInArrow(meet, "a long, b long").distinct()


def frequent_postings(docs: DataFrame, n: int, percent: int, table, often: int) -> DataFrame:
    """(key, set_id, n, f, sketch) of the pair keys that two sets or more have; f: the frequent n-grams of a set."""

    def rows(batches):
        seen: set[int] = set()
        for _, sets in sets_of(batches, n):
            keys, names, sizes, sketches = [], [], [], []
            for s in sets:
                if len(s) and (name := set_id(s)) not in seen:
                    if len(seen) < 200_000:
                        seen.add(name)
                    single, pairs = prefixes(s, table.value, percent, often)
                    if len(pairs):
                        keys.append(pairs)
                        names.append(name)
                        sizes.append((len(s), len(s) - len(single)))
                        sketches.append(sketch_of(s))
            if keys:
                each = [len(k) for k in keys]
                n_f = np.repeat(np.array(sizes, np.int32), each, axis=0)
                columns = [np.concatenate(keys).view(np.int64), np.repeat(np.array(names, np.int64), each), n_f[:, 0], n_f[:, 1], *np.repeat(np.stack(sketches), each, axis=0).T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["key", "set_id", "n", "f", *SKETCH])

    postings = keep(docs.mapInArrow(rows, "key long, set_id long, n int, f int, " + ", ".join(f"{c} long" for c in SKETCH)), "postings")
    shared = postings.groupBy("key").agg(F.min("set_id").alias("low"), F.max("set_id").alias("high")).where("low < high").select("key")
    return postings.join(shared.hint("rebalance"), "key").distinct()


def fetch_sets(docs: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """(set_id, grams) of the wanted sets, once each. wanted: distinct set_id."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(fixed_bitmap(wanted, "set_id", MAP_BITS))

    def rows(batches):
        seen: set[int] = set()
        for _, sets in sets_of(batches, n):
            names = np.array([set_id(s) if len(s) else 0 for s in sets], np.int64)
            hit = bitmap_hits(bits.value, names.view(np.uint64), MAP_BITS)
            out = [(int(v), s) for v, s, h in zip(names, sets, hit, strict=True) if h and len(s) and v not in seen]
            seen.update(v for v, _ in out[: max(0, 200_000 - len(seen))])
            if out:
                ends = np.concatenate([[0], np.cumsum([len(s) for _, s in out])])
                yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in out], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([s for _, s in out]).view(np.int64)))], ["set_id", "grams"])

    found = docs.mapInArrow(rows, "set_id long, grams array<long>").join(wanted, "set_id", "left_semi")
    return keep(found.groupBy("set_id").agg(F.first("grams").alias("grams")), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) with the sizes na, nb and the overlap of their sets; sizes too far apart go first."""
    size = sets.select("set_id", F.size("grams").alias("n"))
    left, right = size.toDF("a", "na"), size.toDF("b", "nb")
    near = pairs.join(left, "a").join(right, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return overlaps(near, sets)


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    both = pairs.join(sets.toDF("a", "ga"), "a").join(sets.toDF("b", "gb"), "b")
    return both.withColumn("both", F.size(F.array_intersect("ga", "gb"))).drop("ga", "gb")


def linked(percent: int):
    return F.lit(100) * F.col("both") >= F.lit(percent) * (F.col("na") + F.col("nb") - F.col("both"))


def may_link(percent: int):
    """Sizes within reach, and enough frequent n-grams: a pair that shares a rare one is found by that."""
    sizes = F.lit(100) * F.least("na", "nb") >= F.lit(percent) * F.greatest("na", "nb")
    return sizes & (F.lit(100 + percent) * F.least("fa", "fb") >= F.lit(percent) * (F.col("na") + F.col("nb")))


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(set_id, component) after links(a, b) have joined components."""
    ends = links.join(labels.toDF("a", "ca"), "a").join(labels.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b")
    new = components(ends).toDF("component", "now")
    return keep(labels.join(new.hint("rebalance"), "component", "left").select("set_id", F.coalesce("now", "component").alias("component")), "labels")


def centred(postings: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Links of every list's sets with one centre, and the lists with each set's distance to it."""
    # the centre: the set with most frequent n-grams for its size
    centres = postings.groupBy("key").agg(F.min(F.struct(-F.floor(F.col("f") * 16 / F.col("n")), "set_id", "n")).alias("c"))
    star = keep(postings.join(centres.select("key", F.col("c.set_id").alias("b"), F.col("c.n").alias("nb")).hint("rebalance"), "key"), "centres")
    pairs = star.where("set_id <> b").select(F.col("set_id").alias("a"), "b", F.col("n").alias("na"), "nb").distinct()
    known = keep(overlaps(pairs, sets), "distances")
    far = known.select(F.col("a").alias("set_id"), "b", (1 - F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("dist"))
    lists = star.join(far, ["set_id", "b"], "left").select("key", "set_id", "n", "f", *SKETCH, F.coalesce("dist", F.lit(0.0)).alias("dist"))
    return known.where(linked(percent)).select("a", "b"), lists


def closing(lists: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between sets of one list and different components.

    Only lists of two components or more count, and in them only pairs that sizes, frequent
    n-grams, sketches and the triangle inequality of the Jaccard distance to the list's centre
    leave possible. Long lists are dealt into blocks, each compared with the whole list in a task of its own.
    """
    lists = lists.join(labels.hint("rebalance"), "set_id")
    mixed = lists.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("length")).where("low < high")
    lists = keep(lists.join(mixed.select("key", F.ceil(F.col("length") / block).cast("int").alias("blocks")).hint("rebalance"), "key"), "lists")
    left = lists.select("key", F.pmod(F.xxhash64("set_id"), "blocks").cast("int").alias("block"), F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("f").alias("fa"), F.col("dist").alias("da"), F.col("component").alias("ca"), *[F.col(c).alias("a" + c) for c in SKETCH])
    right = lists.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("f").alias("fb"), F.col("dist").alias("db"), F.col("component").alias("cb"), *[F.col(c).alias("b" + c) for c in SKETCH])
    near = F.abs(F.col("da") - F.col("db")) <= 1 - percent / 100 + 1e-9
    apart = sum((F.bit_count(F.col("a" + c).bitwiseXOR(F.col("b" + c))) for c in SKETCH), F.lit(0))
    # twice the overlap is at most both sizes less the places apart
    alike = (100 + percent) * (F.col("na") + F.col("nb") - apart) >= 2 * percent * (F.col("na") + F.col("nb"))
    pairs = left.join(right, ["key", "block"]).where(F.col("a") < F.col("b")).where(F.col("ca") != F.col("cb")).where(may_link(percent)).where(near).where(alike)
    return overlaps(pairs.select("a", "b", "na", "nb").distinct(), sets).where(linked(percent)).select("a", "b")


def join_components(docs: DataFrame, n: int = 5, percent: int = 75, rare: int = RARE, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = keep(describe(docs, n), "described")
    table, often = class_table(docs.select("text"), n), rare.bit_length() - 1
    singles = keep(rare_candidates(docs.select("text"), n, percent, table, often), "candidates")
    postings = keep(frequent_postings(docs.select("text"), n, percent, table, often), "shared")
    wanted = keep(singles.select("a").union(singles.select("b")).union(postings.select("set_id")).toDF("set_id").distinct(), "wanted")
    sets = fetch_sets(docs.select("text"), n, wanted)
    labels = keep(wanted.select("set_id", F.col("set_id").alias("component")), "labels")
    near, lists = centred(postings, sets, percent)
    labels = merged(labels, verified(singles, sets, percent).where(linked(percent)).select("a", "b").union(near))
    parts = merged(labels, closing(lists, labels, sets, percent, block))

    first = rows.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("first"))
    named = first.join(parts, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = keep(named.join(lowest, "component").select("set_id", "component_id"), "named")
    out = rows.join(named.hint("rebalance"), "set_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
