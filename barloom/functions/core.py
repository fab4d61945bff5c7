"""Windows, carry-forward, timeframes, fingerprints and the first-hit join."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

PRICE = "decimal(18,8)"
#: Seconds of every fixed timeframe; a month is a calendar month.
TIMEFRAMES = {
    "1s": 1, "1m": 60, "3m": 180, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "2h": 7200, "4h": 14400,
    "6h": 21600, "8h": 28800, "12h": 43200, "1d": 86400, "3d": 259200, "1w": 604800,
}
#: Nodes of a block in first-hit joins, levels of blocks, and stretches of price that a node tells apart.
BLOCK, LEVELS, STRETCHES = 256, 3, 32


_KEYS: ContextVar[tuple[str, ...]] = ContextVar("window_keys", default=("series_key",))


@contextmanager
def windows_by(*keys: str) -> Iterator[None]:
    """Layers that are built here have these keys of windows, not the series alone."""
    token = _KEYS.set(keys)
    try:
        yield
    finally:
        _KEYS.reset(token)


def series() -> WindowSpec:
    """The one window of all layers, so that they share an exchange and a sort."""
    return Window.partitionBy(*_KEYS.get()).orderBy("bar_index")


def rows(start: int, end: int) -> WindowSpec:
    return series().rowsBetween(start, end)


def upto() -> WindowSpec:
    return rows(Window.unboundedPreceding, 0)


def ffill(column: Column) -> Column:
    """The last value so far, this bar included."""
    return F.last(column, ignorenulls=True).over(upto())


def ffill_prev(column: Column) -> Column:
    """The last value before this bar."""
    return F.last(column, ignorenulls=True).over(rows(Window.unboundedPreceding, -1))


def lag(column: str | Column, n: int = 1) -> Column:
    return F.lag(column, n).over(series())


def close_time(opened_at: Column, timeframe: str) -> Column:
    """When a bar that opens then closes; months open on their first day, UTC."""
    if timeframe == "1M":
        return F.add_months(opened_at, 1).cast("timestamp")
    return opened_at + F.expr(f"INTERVAL {TIMEFRAMES[timeframe]} SECONDS")


def require_higher_multiple(lower: str, higher: str) -> int:
    """How many lower bars a higher one holds; it must be a whole number above one, and no month."""
    if "1M" in (lower, higher):
        raise ValueError("months have no fixed number of bars")
    times, rest = divmod(TIMEFRAMES[higher], TIMEFRAMES[lower])
    if rest or times < 2:
        raise ValueError(f"{higher} is no multiple of {lower}")
    return times


def settled(df: DataFrame) -> DataFrame:
    """df computed once for the several plans that start from it: in the cluster's checkpoint folder, else cached."""
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return df.checkpoint()
    return df.persist()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name in the folder that driver and executors share; a local one only where both are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='barloom-')}"
    return f"{base}/{name}-{uuid.uuid4().hex}"


def identity(*columns: str | Column) -> Column:
    """A content id: SHA-256 of the canonical JSON of natural keys."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def dataset_fingerprint(df: DataFrame, key: str = "series_key", record: Column | None = None) -> DataFrame:
    """(key, n, fingerprint): the sum modulo 2**256 of the SHA-256 of all canonical records of a series.

    In any order and by partial sums; a record that is there twice counts twice. Without record, it is
    the JSON of all other columns by name, nulls included.
    """
    if record is None:
        record = F.to_json(F.struct(*sorted(c for c in df.columns if c != key)), {"ignoreNullFields": "false"})
    digest = df.select(key, F.sha2(record, 256).alias("digest"))
    limb = "decimal(38,0)"
    parts = [F.sum(F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast(limb)).alias(f"part{k}") for k in range(8)]
    out = digest.groupBy(key).agg(F.count("*").alias("n"), *parts).withColumn("over", F.lit(0).cast(limb))
    unit = F.lit(1 << 32).cast(limb)
    for k in reversed(range(8)):  # from the last 32 bits on, what exceeds them goes to those before
        out = out.withColumn("whole", (F.col(f"part{k}") + F.col("over")).cast(limb)).withColumn(f"part{k}", F.col("whole") % unit)
        out = out.withColumn("over", ((F.col("whole") - F.col(f"part{k}")) / unit).cast(limb))
    return out.select(key, "n", F.concat(*[F.lpad(F.lower(F.hex(F.col(f"part{k}").cast("long"))), 8, "0") for k in range(8)]).alias("fingerprint"))


def stretches(spans: Column, most: int) -> Column:
    """The union of spans (low, high) as at most `most` stretches in order; with more, the smallest gaps count as covered.

    Spans that only touch stay apart, so a zone that reaches inside the union reaches inside a span,
    zones without width included.
    """

    def joined(sorted_spans: Column, meets: Callable[[Column, Column], Column]) -> Column:
        first = F.slice(sorted_spans, 1, 1)

        def add(done: Column, x: Column) -> Column:
            last = F.element_at(done, -1)
            grown = F.struct(last["low"].alias("low"), F.greatest(last["high"], x["high"]).alias("high"))
            return F.when(meets(last, x), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(x)))

        return F.aggregate(F.slice(sorted_spans, F.lit(2), F.size(sorted_spans)), first, add)

    union = joined(F.sort_array(spans), lambda last, x: x["low"] < last["high"])
    gaps = F.zip_with(F.slice(union, F.lit(1), F.size(union) - 1), F.slice(union, F.lit(2), F.size(union)), lambda a, b: b["low"] - a["high"])
    least = F.get(F.sort_array(gaps, asc=False), most - 1)
    few = joined(union, lambda last, x: x["low"] - last["high"] <= least)
    return F.when(F.size(union) > most, few).otherwise(union)


def _first(zones: DataFrame, bars: DataFrame, extremes: dict[str, tuple[str | Column, str]], test: Callable[[Column], Column], block: int, levels: int, most: int = STRETCHES) -> DataFrame:
    """zones with c0, the first bar after start_index that passes test, and c1: the first block that seems to hold one.

    Bars lie in blocks, blocks in blocks of blocks, up to the last level, which holds all that is
    left. A zone looks at what comes after it in its own block, then in the block of that block,
    and so on, and goes down again where it finds a node. So it meets a few blocks, whatever the
    length of its series, and every step is an equality join of one row for each zone. Nodes hold
    extremes (name: (column of bars, max, min or union)), which must pass test wherever a bar below does.
    """
    peak = {"max": F.array_max, "min": F.array_min, "union": lambda x: stretches(F.flatten(x), most)}
    nodes = bars.select("series_key", F.col("bar_index").cast("long").alias("i"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, (c, _) in extremes.items()])
    chunks = []
    for k in range(levels):
        parent = F.floor(F.col("i") / block).cast("long") if k < levels - 1 else F.lit(0).cast("long")
        items = F.sort_array(F.collect_list(F.struct("i", *extremes)))  # a block's worth of nodes
        chunks.append(nodes.groupBy("series_key", parent.alias("node")).agg(items.alias("items")))
        nodes = chunks[-1].select("series_key", F.col("node").alias("i"), *[peak[m](F.col(f"items.{n}")).alias(n) for n, (_, m) in extremes.items()])

    def look(z: DataFrame, k: int, wanted: Column, node: Column, after: Column) -> DataFrame:
        # zones that don't look get a key of their own that no chunk has, so that they don't meet in one task
        z = z.withColumn("node", F.when(wanted, node).otherwise(-1 - F.col("start_index")).cast("long")).join(chunks[k], ["series_key", "node"], "left")
        found = F.get(F.filter("items", lambda x: (x["i"] > after) & test(x)), 0)["i"]
        return z.withColumn(f"c{k}", F.coalesce(F.col(f"c{k}"), found)).drop("node", "items")

    out = zones.withColumns({f"c{k}": F.lit(None).cast("long") for k in range(levels)})
    nothing = F.lit(True)
    for k in range(levels):
        node = F.floor(F.col("start_index") / block ** (k + 1)) if k < levels - 1 else F.lit(0)
        out = look(out, k, nothing, node, F.floor(F.col("start_index") / block**k))
        nothing = nothing & F.col(f"c{k}").isNull()
    for k in reversed(range(levels - 1)):
        out = look(out, k, F.col(f"c{k}").isNull() & F.col(f"c{k + 1}").isNotNull(), F.col(f"c{k + 1}"), F.lit(-1))
    return out.withColumn("c1", F.coalesce(*[F.col(f"c{k}") for k in range(1, levels)])).drop(*[f"c{k}" for k in range(2, levels)])


def first_hit(zones: DataFrame, bars: DataFrame, over: str, under: str, block: int = BLOCK, levels: int = LEVELS) -> DataFrame:
    """(zone_id, hit_index): the first bar after start_index whose over is above bound or, for zones that aren't above, whose under is below it.

    zones: series_key, zone_id, start_index, bound, above.
    """
    zones = zones.select("series_key", "zone_id", "start_index", "bound", "above")
    test = lambda x: F.when(F.col("above"), x["top"] > F.col("bound")).otherwise(x["bottom"] < F.col("bound"))
    out = _first(zones, bars, {"top": (over, "max"), "bottom": (under, "min")}, test, block, levels)
    return out.where("c0 IS NOT NULL").select("zone_id", F.col("c0").alias("hit_index"))


def overlapping(zones: DataFrame, bars: DataFrame, block: int, levels: int, most: int) -> tuple[DataFrame, DataFrame, Callable[[Column], Column]]:
    """(zones with c0 and c1 as of _first, bars as nodes, the test): zones against the stretches of price that bars and blocks cover."""
    late = "known_at" in zones.columns
    zones = zones.select("series_key", "zone_id", "start_index", "zone_low", "zone_high", *(["known_at"] if late else []))
    span = F.array(F.struct(F.col("low").alias("low"), F.col("high").alias("high")))
    extremes = {"spans": (span, "union"), **({"newest": ("opened_at", "max")} if late else {})}

    def inside(x: Column) -> Column:
        within = F.exists(x["spans"], lambda s: (s["high"] > F.col("zone_low")) & (s["low"] < F.col("zone_high")))
        return within & (x["newest"] >= F.col("known_at")) if late else within

    nodes = bars.select("series_key", F.col("bar_index").cast("long").alias("i"), span.alias("spans"), *(["opened_at"] if late else []))
    nodes = nodes.withColumn("newest", F.col("opened_at") if late else F.lit(None).cast("timestamp"))
    return _first(zones, bars, extremes, inside, block, levels, most), nodes, inside


def first_overlap(zones: DataFrame, bars: DataFrame, block: int = BLOCK, levels: int = LEVELS, most: int = STRETCHES) -> DataFrame:
    """(zone_id, hit_index): the first bar after start_index that reaches inside (zone_low, zone_high), ends excluded.

    Zones with a column known_at only meet bars that open at that time or later. Blocks hold the
    stretches of price that their bars cover, so a zone that the price jumps over passes them by. Only
    where a block covers more than `most` stretches, or is the one in which a zone becomes known, may
    it seem to hold a bar that it doesn't; such zones meet all later blocks.
    """
    found, nodes, inside = overlapping(zones, bars, block, levels, most)
    hits = found.where("c0 IS NOT NULL").select("zone_id", F.col("c0").alias("hit_index"))
    unsure = found.where("c0 IS NULL AND c1 IS NOT NULL").drop("c0", "c1")
    nodes = nodes.withColumn("block", F.floor(F.col("i") / block))
    sums = nodes.groupBy("series_key", "block").agg(stretches(F.flatten(F.collect_list("spans")), most).alias("spans"), F.max("newest").alias("newest"))  # a block's worth of bars
    row = F.struct("spans", "newest")
    near = unsure.join(sums.select("series_key", "block", row.alias("b")), "series_key").where((F.col("block") >= F.floor(F.col("start_index") / block)) & inside(F.col("b"))).drop("b")
    rest = near.join(nodes.select("series_key", "block", "i", row.alias("b")), ["series_key", "block"]).where((F.col("i") > F.col("start_index")) & inside(F.col("b")))
    return hits.unionByName(rest.groupBy("zone_id").agg(F.min("i").alias("hit_index")))
