"""Higher-timeframe context as of a bar's open, confluence, and the symbol registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.chunks import running
from barloom.functions.core import TIMEFRAMES


def as_of(primary: DataFrame, other: DataFrame, columns: list[str], prefix: str, keys: tuple[str, ...] = ("symbol",), span: int | None = None) -> DataFrame:
    """The latest row of other that was available when each primary bar opened; null where there is none.

    Both sides go through one window in time order - others first where times are equal - so there
    is one exchange and no join condition on a range. With span (seconds) windows are cut into spans
    of time, and the last row of the spans before is carried into each, so no task holds a whole key.
    """
    p = primary.withColumn("row", F.struct(*primary.columns)).select(*keys, F.col("opened_at").alias("t"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("tie"), "row")
    kind = F.struct(*[F.col(c) for c in ["bar_index", *columns]])
    o = other.select(*keys, F.col("available_at").alias("t"), F.lit(0).alias("side"), F.col("bar_index").cast("long").alias("tie"), kind.alias("found"))
    both = p.unionByName(o, allowMissingColumns=True)
    within = list(keys)
    if span:
        both = both.withColumn("span", F.floor(F.unix_seconds("t") / span).cast("long"))
        within.append("span")
    order = Window.partitionBy(*within).orderBy("t", "side", "tie").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("found", F.last("found", ignorenulls=True).over(order)).where("side = 1")
    if span:
        ends = both.groupBy(*within).agg(F.max_by("found", F.when(F.col("side") == 0, F.struct("t", "tie"))).alias("end"))
        earlier = Window.partitionBy(*keys).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*within, F.last("end", ignorenulls=True).over(earlier).alias("carried"))
        out = out.join(carried, within).withColumn("found", F.coalesce("found", "carried"))
    return out.select("row.*", *[F.col(f"found.{c}").alias(f"{prefix}_{c}") for c in ["bar_index", *columns]])


def add_confluence(primary: DataFrame, higher: dict[str, DataFrame], chunk_bars: int | None = None) -> DataFrame:
    """direction_<tf> and cursor_<tf> of every higher timeframe, and their confluence; chunk_bars: higher bars that a task meets at once."""
    out = primary
    for tf, facts in higher.items():
        out = as_of(out, facts, ["trend", "ready"], f"htf_{tf}", span=chunk_bars and chunk_bars * TIMEFRAMES[tf])
        missing = F.col(f"htf_{tf}_bar_index").isNull()
        unready = ~F.coalesce(F.col(f"htf_{tf}_ready"), F.lit(False))
        direction = F.when(missing | unready, "INSUFFICIENT_CONTEXT").when(F.col(f"htf_{tf}_trend") == "ranging", "NEUTRAL").otherwise(F.upper(f"htf_{tf}_trend"))
        reason = F.when(missing, "no_completed_htf_candle").when(unready, "htf_structure_not_ready")
        out = out.withColumns({f"direction_{tf}": direction, f"reason_{tf}": reason, f"cursor_{tf}": F.col(f"htf_{tf}_bar_index")})
        out = out.drop(*[f"htf_{tf}_{c}" for c in ("bar_index", "trend", "ready")])
    known = F.array_distinct(F.filter(F.array(*[F.col(f"direction_{tf}") for tf in higher]), lambda d: d != "INSUFFICIENT_CONTEXT"))
    return out.withColumn("confluence", F.when(F.size(known) == 0, "INSUFFICIENT_CONTEXT").when(F.size(known) == 1, F.element_at(known, 1)).otherwise("MIXED"))


#: What a bar publishes, and the records of its state.
PUBLISHED = ("swing", "liquidity_pool", "sweep", "displacement", "fvg", "order_block", "pd_array", "dealing_range", "equilibrium", "ote_zone")
STATE = ("structure_context", "pd_snapshot", "ote_observation", "ote_snapshot")


def published_evidence(facts: DataFrame, life: DataFrame, log: DataFrame, chunk_bars: int | None = None) -> DataFrame:
    """facts with evidence: how many records of each kind its series has published up to each bar.

    life and log: the facts' pools and their change log. A pool's version, a sweep, a displacement, a
    gap and an order block are each an array, too; a range comes with its equilibrium and its zone.
    """
    counts = log.groupBy("series_key", "bar_index").agg(F.count("*").alias("n_pools"))
    swept = life.where("status = 'swept'").groupBy("series_key", F.col("breach_index").alias("bar_index")).agg(F.count("*").alias("n_swept"))
    out = facts.join(counts, ["series_key", "bar_index"], "left").join(swept, ["series_key", "bar_index"], "left")
    one = lambda there: F.coalesce(there, F.lit(False)).cast("long")
    ranged = one(F.col("range_confirm") == F.col("bar_index"))
    new = {
        "swing": one(F.col("swing_high").isNotNull()) + one(F.col("swing_low").isNotNull()), "liquidity_pool": F.coalesce("n_pools", F.lit(0)), "sweep": F.coalesce("n_swept", F.lit(0)),
        "displacement": one(F.col("displacement").isNotNull()), "fvg": one(F.col("gap").isNotNull()), "order_block": one(F.col("block").isNotNull()),
        "dealing_range": ranged, "equilibrium": ranged, "ote_zone": ranged,
    }
    new["pd_array"] = sum((new[k] for k in ("sweep", "displacement", "fvg", "order_block")), new["liquidity_pool"])
    out = running(out, {f"e_{k}": new[k] for k in PUBLISHED}, chunk_bars)
    return out.withColumn("evidence", F.struct(*[F.col(f"e_{k}").alias(k) for k in PUBLISHED])).drop("n_pools", "n_swept", *[f"e_{k}" for k in PUBLISHED])


def htf_evidence(primary: DataFrame, evidence: DataFrame, tf: str, chunk_bars: int | None = None) -> DataFrame:
    """Each primary bar with the number of records of each kind that higher bars had published when it opened.

    The latest higher bar's records of its state count once each. Counts run along the higher
    series, and one row of them is found for each primary bar, so nothing grows with pairs.
    """
    out = as_of(primary, evidence, ["evidence"], "htf", span=chunk_bars and chunk_bars * TIMEFRAMES[tf])
    none = F.col("htf_bar_index").isNull()
    counts = {k: F.coalesce(F.col("htf_evidence")[k], F.lit(0)) for k in PUBLISHED} | {k: F.when(none, 0).otherwise(1).cast("long") for k in STATE}
    return out.withColumns({f"{k}_{tf}": v for k, v in counts.items()}).withColumnRenamed("htf_bar_index", f"cursor_{tf}").drop("htf_evidence")


def normalized(symbol):
    """Upper case; null where it isn't 2 to 30 letters and digits."""
    s = F.upper(F.trim(symbol))
    return F.when(s.rlike("^[A-Z0-9]{2,30}$"), s)


def add_registry(df: DataFrame, registry: DataFrame, mode: str) -> DataFrame:
    """status and status_reason of each bar's symbol by an allow or deny list (a column symbol)."""
    listed = registry.select(normalized(F.col("symbol")).alias("rs")).where("rs IS NOT NULL").distinct().withColumn("listed", F.lit(True))
    out = df.join(listed, normalized(F.col("symbol")) == F.col("rs"), "left").drop("rs")
    here = F.coalesce("listed", F.lit(False))
    name = "allow_list" if mode == "allow" else "deny_list"
    status = F.when(here, "HALAL" if mode == "allow" else "HARAM").otherwise("UNKNOWN")
    return out.withColumn("status_reason", F.when(here, f"listed_in_{name}").otherwise(f"absent_from_{name}")).withColumn("status", status).drop("listed")
