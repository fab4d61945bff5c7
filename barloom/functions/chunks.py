"""Long series in chunks: layers of bounded reach with overlaps, and state carried between chunks.

A chunk is `size` bars of a series. A layer that looks a fixed number of bars back or ahead runs in
every chunk over its own bars and copies of those that it can reach (``within``). What reaches back
without bound is carried in two passes: each chunk's own part, one row for each chunk, and then what
all chunks before it leave (``before``); for recurrences x -> a x + b the parts compose, level by
level (``affine``). So a task holds a chunk, not a series.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.core import upto, windows_by

KEYS = ("series_key", "chunk")
#: Children of a node when recurrences are composed, and levels of nodes.
FAN, LEVELS = 256, 3


def place(size: int, index: str = "bar_index") -> Column:
    """The chunk that a bar belongs to."""
    return F.floor(F.col(index) / size).cast("long")


def within(df: DataFrame, size: int, back: int, ahead: int, layer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """layer(df) where no row depends on more than `back` bars before it and `ahead` after; keeps the column chunk."""
    first, last = F.greatest(F.lit(0), F.floor((F.col("bar_index") - ahead) / size)).cast("long"), F.floor((F.col("bar_index") + back) / size).cast("long")
    # dealt by both keys: rows already dealt by series would satisfy a window by series and chunk, in one task
    copies = df.drop("chunk").withColumn("chunk", F.explode(F.sequence(first, last))).repartition(*KEYS)
    with windows_by(*KEYS):
        return layer(copies).where(F.col("chunk") == place(size))


def before(parts: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(series_key, chunk, values): aggregates of columns of parts, a row for each chunk, over all chunks before."""
    w = Window.partitionBy("series_key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*KEYS, *[v.over(w).alias(k) for k, v in values.items()])


def latest(column: str) -> Column:
    return F.last(column, ignorenulls=True)


def affine(parts: DataFrame, names: list[str], fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(series_key, chunk, name...): the state at the start of each chunk, from 0, of recurrences x -> a x + b.

    parts: series_key, chunk, and for each name a struct (a, b), the chunk's steps as one. Steps
    compose to (a2 a1, a2 b1 + b2): nodes of `fan` chunks are composed, nodes of these, and so on up
    to one for each series; then states go down again, each node dealing its own to its children.
    """
    zero = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))

    def composed(n: str) -> Column:
        return F.aggregate("items", zero, lambda x, y: F.struct((y[n]["a"] * x["a"]).alias("a"), (y[n]["a"] * x["b"] + y[n]["b"]).alias("b")))

    def passed(n: str) -> Column:
        # the states before each child, in order: one more than there are children
        return F.aggregate("items", F.array(F.col(n)), lambda x, y: F.concat(x, F.array(y[n]["a"] * F.element_at(x, -1) + y[n]["b"])))

    nodes, tree = parts.select("series_key", F.col("chunk").alias("node"), *names), []
    for k in range(levels):
        parent = F.floor(F.col("node") / fan).cast("long") if k < levels - 1 else F.lit(0).cast("long")
        items = F.sort_array(F.collect_list(F.struct("node", *names)))  # a node's worth of children
        tree.append(nodes.groupBy("series_key", parent.alias("parent")).agg(items.alias("items")))
        nodes = tree[-1].select("series_key", F.col("parent").alias("node"), *[composed(n).alias(n) for n in names])
    states = nodes.select("series_key", F.col("node").alias("parent"), *[F.lit(0.0).alias(n) for n in names])
    for level in reversed(tree):
        own = level.join(states, ["series_key", "parent"]).select("series_key", "items", *[passed(n).alias(n) for n in names])
        dealt = own.select("series_key", F.explode(F.arrays_zip(F.col("items.node").alias("parent"), *names)).alias("child"))
        states = dealt.select("series_key", "child.parent", *[f"child.{n}" for n in names]).where("parent IS NOT NULL")
    return states.withColumnRenamed("parent", "chunk")


def running(df: DataFrame, values: dict[str, Column], size: int | None) -> DataFrame:
    """df with running sums of values along each series, this bar's included; in chunks of `size` bars, or none."""
    if size is None:
        return df.withColumns({k: F.sum(v).over(upto()) for k, v in values.items()})
    parts = df.drop("chunk").withColumns(values | {"chunk": place(size)}).repartition(*KEYS)
    sums = parts.groupBy(*KEYS).agg(*[F.sum(k).alias(k) for k in values])
    carried = before(sums, {f"carry_{k}": F.sum(k) for k in values})
    with windows_by(*KEYS):
        out = parts.join(carried, list(KEYS)).withColumns({k: F.sum(k).over(upto()) + F.coalesce(f"carry_{k}", F.lit(0)) for k in values})
    return out.drop("chunk", *[f"carry_{k}" for k in values])


def numbered(candles: DataFrame, seconds: int) -> DataFrame:
    """bar_index in time order: rows of a span of time are numbered in it, and what earlier spans hold is added."""
    spans = candles.withColumn("span", F.floor(F.unix_seconds("opened_at") / seconds).cast("long")).repartition("series_key", "span")
    sizes = spans.groupBy("series_key", "span").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("series_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("series_key", "span", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("series_key", "span").orderBy("opened_at"))
    return spans.withColumn("own", own).join(offsets, ["series_key", "span"]).withColumn("bar_index", (F.col("own") - 1 + F.col("offset")).cast("long")).drop("own", "offset", "span")
