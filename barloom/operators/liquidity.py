"""Liquidity pools, their sweeps, and the life of order blocks after they are published."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.core import first_hit, first_overlap, rows, settled
from barloom.plans.config import Config

#: Times that swings are split by time and by price before pools with a tolerance are walked.
SPLITS = 3


def touches(facts: DataFrame) -> DataFrame:
    """Every confirmed swing: series_key, symbol, side, price, confirm, known_at."""
    kinds = F.array(
        F.struct(F.lit("buy_side").alias("side"), F.col("swing_high.price").alias("price")),
        F.struct(F.lit("sell_side").alias("side"), F.col("swing_low.price").alias("price")),
    )
    out = facts.select("series_key", "symbol", F.col("bar_index").alias("confirm"), F.col("available_at").alias("known_at"), F.explode(F.filter(kinds, lambda k: k["price"].isNotNull())).alias("k"))
    return out.select("series_key", "symbol", "k.side", "k.price", "confirm", "known_at")


def touched(facts: DataFrame, carried: DataFrame | None) -> DataFrame:
    """touches with since, touched_index and members, and each pool that is carried into these bars as one touch more, which they can breach from their first on."""
    own = touches(facts).withColumns({"confirm": F.col("confirm").cast("long"), "since": F.col("confirm").cast("long"), "touched_index": F.col("confirm").cast("long"), "members": F.lit(1).cast("long")})
    if carried is None:
        return own
    old = carried.select("series_key", "symbol", "side", "price", F.col("created_index").cast("long").alias("confirm"), "known_at", F.col("last_index").cast("long").alias("since"), F.col("touched_index").cast("long").alias("touched_index"), "members")
    return own.unionByName(old)


def exact_pools(facts: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Pools without tolerance: swings of one price with no breach between them."""
    swings = touched(facts, carried).withColumn("zone_id", F.concat_ws("|", "series_key", "side", "confirm"))
    zones = swings.select("series_key", "zone_id", F.col("since").alias("start_index"), F.col("price").alias("bound"), (F.col("side") == "buy_side").alias("above"))
    hits = first_hit(zones, facts, "high", "low")
    swings = swings.join(hits, "zone_id", "left")
    return swings.groupBy("series_key", "symbol", "side", "price", F.col("hit_index").alias("breach_index")).agg(
        F.min("confirm").alias("created_index"), F.max("touched_index").alias("touched_index"), F.sum("members").alias("members"), F.max_by("known_at", "touched_index").alias("known_at")
    ).withColumns({"lower": F.col("price"), "upper": F.col("price")})


def apart(swings: DataFrame, rounds: int = SPLITS) -> DataFrame:
    """swings with part: those of different parts can't be in one pool, whatever pools there are.

    A swing's rectangle reaches from its bar to the breach of its own band, and across the band. Where
    no rectangle reaches across a time, nothing is active; where none reaches across a price, no band
    holds what lies beyond. Splitting by one shows more places to split by the other, so both alternate.
    """
    out = swings.withColumn("part", F.xxhash64("series_key", "side"))
    whole = ["series_key", "side", "part"]
    never = F.lit((1 << 62) - 1)
    for _ in range(rounds):
        for first, low, high, meets in (("confirm", F.col("confirm"), F.coalesce("hit_index", never), True), ("lower", F.col("lower"), F.col("upper"), False)):
            earlier = Window.partitionBy(*whole).orderBy(first, "confirm").rowsBetween(Window.unboundedPreceding, -1)
            reach = F.max(high).over(earlier)
            # a pool that this bar breaches is gone when its swing looks for one; bands hold their ends
            fresh = (low >= reach) if meets else (low > reach)
            out = out.withColumn("fresh", F.coalesce(fresh, F.lit(False)).cast("int"))
            out = out.withColumn("run", F.sum("fresh").over(Window.partitionBy(*whole).orderBy(first, "confirm"))).withColumn("part", F.xxhash64("part", "run")).drop("fresh", "run")
    return out


def heads(swings: DataFrame) -> DataFrame:
    """(series_key, side, confirm, head): the swing that founded the pool which each swing joins or founds.

    Swings of a part go by in order, and only its active pools are held.
    """

    def walk(batches):
        last, active = None, []
        for b in batches:
            found = []
            columns = [b.column(c).to_pylist() for c in ("series_key", "side", "part", "confirm", "price", "lower", "upper", "hit_index")]
            for key, side, part, confirm, price, lower, upper, hit in zip(*columns, strict=True):
                if (key, side, part) != last:
                    last, active = (key, side, part), []
                active = [p for p in active if p[3] is None or p[3] > confirm]
                head = next((p[0] for p in active if p[1] <= price <= p[2]), None)
                if head is None:
                    head = confirm
                    active.append((confirm, lower, upper, hit))
                found.append(head)
            yield pa.RecordBatch.from_arrays([b.column("series_key"), b.column("side"), b.column("confirm"), pa.array(found, pa.int64())], ["series_key", "side", "confirm", "head"])

    rows = swings.select("series_key", "side", "part", "confirm", "price", "lower", "upper", "hit_index").repartition("series_key", "side", "part").sortWithinPartitions("series_key", "side", "part", "confirm")
    return rows.mapInArrow(walk, "series_key string, side string, confirm long, head long")


def banded_pools(facts: DataFrame, cfg: Config, carried: DataFrame | None = None) -> DataFrame:
    """Pools with tolerance: a swing joins the oldest active pool whose first band holds it.

    Which swing founds a pool depends on the pools before it, but only on those of its own part. A
    carried pool stands for its founder: carried ones were founded beside one another, so none joins another.
    """
    step = F.lit(str(cfg.pool_tolerance_bps)).cast("decimal(12,8)") * F.lit("0.0001").cast("decimal(4,4)")
    band = F.col("price") * step
    swings = touched(facts, carried).withColumns({"lower": F.bround(F.col("price") - band, 8).cast("decimal(18,8)"), "upper": F.bround(F.col("price") + band, 8).cast("decimal(18,8)")})
    swings = swings.withColumn("zone_id", F.concat_ws("|", "series_key", "side", "confirm"))
    zones = swings.select("series_key", "zone_id", F.col("since").alias("start_index"), F.when(F.col("side") == "buy_side", F.col("upper")).otherwise(F.col("lower")).alias("bound"), (F.col("side") == "buy_side").alias("above"))
    swings = settled(apart(swings.join(first_hit(zones, facts, "high", "low"), "zone_id", "left").drop("zone_id")))
    joined = swings.join(heads(swings), ["series_key", "side", "confirm"])
    own = F.col("confirm") == F.col("head")
    founder = F.max(F.when(own, F.struct("price", "hit_index", "lower", "upper")))
    out = joined.groupBy("series_key", "symbol", "side", F.col("head").alias("created_index")).agg(founder.alias("f"), F.max("touched_index").alias("touched_index"), F.sum("members").alias("members"), F.max_by("known_at", "touched_index").alias("known_at"))
    return out.select("series_key", "symbol", "side", "f.price", F.col("f.hit_index").alias("breach_index"), "created_index", "touched_index", "members", "known_at", "f.lower", "f.upper")


def pools(facts: DataFrame, cfg: Config, carried: DataFrame | None = None) -> DataFrame:
    """One row per pool with its life: created, last touched, members, kind, band, first breach and what that was.

    carried: pools that were active after the bar last_index, where facts are the bars that follow it.
    """
    out = banded_pools(facts, cfg, carried) if cfg.pool_tolerance_bps else exact_pools(facts, carried)
    alone = F.when(F.col("side") == "buy_side", "swing_high").otherwise("swing_low")
    out = out.withColumn("kind", F.when(F.col("members") > 1, F.when(F.col("side") == "buy_side", "equal_highs").otherwise("equal_lows")).otherwise(alone))
    bars = facts.select("series_key", F.col("bar_index").alias("breach_index"), F.col("opened_at").alias("b_open_at"), F.col("prev_close").alias("b_prev"), F.col("open").alias("b_open"), F.col("high").alias("b_high"), F.col("low").alias("b_low"), F.col("close").alias("b_close"))
    out = out.join(bars, ["series_key", "breach_index"], "left")
    buy = F.col("side") == "buy_side"
    outside = F.when(buy, F.greatest("b_prev", "b_open") > F.col("upper")).otherwise(F.least("b_prev", "b_open") < F.col("lower"))
    back = F.when(buy, F.col("b_close") < F.col("lower")).otherwise(F.col("b_close") > F.col("upper"))
    reason = F.when(F.col("breach_index").isNull(), None).when(F.col("known_at") > F.col("b_open_at"), "not_known_at_open").when(outside, "started_outside").when(~back, "not_reclaimed")
    out = out.withColumn("reason", reason)
    out = out.withColumn("status", F.when(F.col("breach_index").isNull(), "active").when(F.col("reason").isNull(), "swept").otherwise("invalidated"))
    return out.withColumn("extreme", F.when(F.col("status") == "swept", F.when(buy, F.col("b_high")).otherwise(F.col("b_low")))).drop("b_open_at", "b_prev", "b_open", "b_high", "b_low", "b_close")


def pool_log(facts: DataFrame, cfg: Config, life: DataFrame | None = None) -> DataFrame:
    """The pools' change log: an active version for each touch, one closing version; life: pools of these facts, if at hand."""
    life = pools(facts, cfg) if life is None else life
    band = ["price", "lower", "upper"]
    pool = life.select("series_key", "symbol", "side", *band, "created_index", "touched_index")
    if cfg.pool_tolerance_bps:
        seen = touches(facts).select("series_key", "side", F.col("price").alias("at"), "confirm").join(pool, ["series_key", "side"]).where("at BETWEEN lower AND upper")
    else:
        seen = touches(facts).select("series_key", "side", "price", "confirm").join(pool, ["series_key", "side", "price"])
    seen = seen.where("confirm BETWEEN created_index AND touched_index")
    one = seen.select("series_key", "symbol", "side", *band, "created_index", F.col("confirm").alias("bar_index"), F.lit("active").alias("status"))
    two = life.where("status <> 'active'").select("series_key", "symbol", "side", *band, "created_index", F.col("breach_index").alias("bar_index"), "status")
    return one.unionByName(two)


def active_at(life: DataFrame, at: int) -> DataFrame:
    """Pools that are active after the bar with this index."""
    return life.where((F.col("created_index") <= at) & (F.col("breach_index").isNull() | (F.col("breach_index") > at)))


def add_sweep_context(facts: DataFrame, life: DataFrame, cfg: Config) -> DataFrame:
    """sweeps (sides on this bar), sweep_context and sweep_index of the newest bar with sweeps within the lookback that was available when this one opened."""
    return add_recent_sweeps(add_sweeps(facts, life), cfg)


def add_sweeps(facts: DataFrame, life: DataFrame) -> DataFrame:
    swept = life.where("status = 'swept'").groupBy("series_key", F.col("breach_index").alias("bar_index")).agg(F.array_sort(F.collect_set("side")).alias("sweeps"))  # two sides at most
    return facts.join(swept, ["series_key", "bar_index"], "left")


def add_recent_sweeps(facts: DataFrame, cfg: Config) -> DataFrame:
    swept = F.when(F.col("sweeps").isNotNull(), F.struct("bar_index", "sweeps", "available_at"))
    out = facts.withColumn("recent", F.collect_list(swept).over(rows(-cfg.sweep_lookback, -1)))  # sweep_lookback at most
    out = out.withColumn("recent", F.try_element_at(F.filter("recent", lambda s: s["available_at"] <= F.col("opened_at")), F.lit(-1)))
    out = out.withColumns({"sweep_index": F.col("recent.bar_index"), "recent": F.col("recent.sweeps")})
    context = F.when(F.col("recent").isNull(), "none").when(F.size("recent") == 2, "after_both").when(F.col("recent")[0] == "buy_side", "after_buy_side").otherwise("after_sell_side")
    return out.withColumn("sweep_context", context).drop("recent")


def published_blocks(facts: DataFrame) -> DataFrame:
    return facts.where("block IS NOT NULL").select("series_key", "symbol", F.col("bar_index").alias("published_index"), F.col("available_at").alias("block_known_at"), F.col("block").alias("direction"), F.col("block_low").alias("zone_low"), F.col("block_high").alias("zone_high"), F.concat_ws("|", "series_key", "bar_index").alias("zone_id"))


def breakers(facts: DataFrame) -> DataFrame:
    """The first close through each order block, and why it is or isn't a breaker of the other direction."""
    blocks = published_blocks(facts)
    bearish = F.col("direction") == "bearish"
    zones = blocks.select("series_key", "zone_id", F.col("published_index").alias("start_index"), F.when(bearish, F.col("zone_high")).otherwise(F.col("zone_low")).alias("bound"), bearish.alias("above"))
    hits = first_hit(zones, facts, "close", "close")
    bars = facts.select("series_key", F.col("bar_index").alias("hit_index"), F.col("opened_at").alias("hit_opened_at"), F.col("prev_close").alias("hit_prev"), F.col("displacement").alias("hit_displacement"), F.col("shift").alias("hit_shift"))
    out = blocks.join(hits, "zone_id").join(bars, ["series_key", "hit_index"])
    other = F.when(F.col("direction") == "bullish", "bearish").otherwise("bullish")
    already = F.when(F.col("direction") == "bullish", F.col("hit_prev") < F.col("zone_low")).otherwise(F.col("hit_prev") > F.col("zone_high"))
    reason = (
        F.when(F.col("block_known_at") > F.col("hit_opened_at"), "SOURCE_NOT_KNOWN_AT_OPEN").when(already, "PREVIOUS_CLOSE_ALREADY_BEYOND")
        .when(F.col("hit_displacement").isNull(), "MISSING_DISPLACEMENT").when(F.col("hit_displacement") != other, "WRONG_DISPLACEMENT_DIRECTION")
        .when(F.col("hit_shift").isNull(), "MISSING_MSS").when(F.col("hit_shift") != other, "WRONG_MSS_DIRECTION")
    )
    return out.withColumn("rejection", reason).withColumn("breaker", F.when(F.col("rejection").isNull(), other)).select("series_key", "symbol", "zone_id", "published_index", "direction", "zone_low", "zone_high", "hit_index", "rejection", "breaker")


def mitigations(facts: DataFrame) -> DataFrame:
    """The first later bar that reaches inside each order block and opened when that was known, unless a breaker of it came before; with the overlap."""
    blocks = published_blocks(facts)
    hits = first_overlap(blocks.withColumns({"start_index": F.col("published_index"), "known_at": F.col("block_known_at")}), facts)
    broken = breakers(facts).where("breaker IS NOT NULL").select("zone_id", F.col("hit_index").alias("broken_index"))
    out = blocks.join(hits, "zone_id").join(broken, "zone_id", "left").where("broken_index IS NULL OR broken_index > hit_index")
    bars = facts.select("series_key", F.col("bar_index").alias("hit_index"), F.col("high").alias("h"), F.col("low").alias("l"))
    out = out.join(bars, ["series_key", "hit_index"])
    low, high = F.greatest("zone_low", "l"), F.least("zone_high", "h")
    return out.select("series_key", "symbol", "zone_id", "published_index", "direction", "hit_index", low.alias("overlap_low"), high.alias("overlap_high"), (high - low).alias("overlap_size"))
