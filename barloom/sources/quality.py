"""Data-quality facts of candle tables: gaps, intervals, freshness, conditions and their roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.core import identity

# Severity of each condition.
SEVERITY = {
    "data_duplicates_removed": "INFO", "data_rows_trimmed": "INFO", "data_missing_rows_dropped": "WARNING", "data_incomplete_rows_dropped": "WARNING", "data_reordered": "WARNING", "data_malformed": "WARNING",
    "data_stale": "WARNING", "data_gap": "WARNING", "data_interval_anomaly": "WARNING", "data_unavailable": "CRITICAL", "data_conflicting_duplicate": "CRITICAL", "data_future_timestamp": "CRITICAL",
}
RANK = ("HEALTHY", "UNKNOWN", "DEGRADED", "FAILING")


def _micros(c: Column) -> Column:
    return F.unix_micros(c)


def intervals(bars: DataFrame, seconds: int, tolerance: int = 0) -> DataFrame:
    """Each bar's distance from where it was expected: whole intervals missing, the rest, and what that means."""
    w = Window.partitionBy("series_key").orderBy("bar_index")
    out = bars.withColumn("prev_opened_at", F.lag("opened_at").over(w)).where("prev_opened_at IS NOT NULL")
    out = out.withColumn("offset_us", _micros(F.col("opened_at")) - _micros(F.col("prev_opened_at")) - seconds * 1_000_000)
    step = seconds * 1_000_000
    out = out.withColumn("intervals", F.floor(F.col("offset_us") / step)).withColumn("rest_us", F.pmod("offset_us", F.lit(step)))
    kind = F.when(F.col("offset_us") < 0, "overlap").when(F.col("rest_us") != 0, "anomaly").when(F.col("intervals") > tolerance, "gap")
    return out.withColumn("condition", kind)


def internal_gaps(bars: DataFrame, seconds: int) -> DataFrame:
    """(series_key, expected_at, actual_at, missing) of every gap inside a series."""
    found = intervals(bars, seconds).where("offset_us > 0")
    return found.select("series_key", (F.col("prev_opened_at") + F.expr(f"INTERVAL {seconds} SECONDS")).alias("expected_at"), F.col("opened_at").alias("actual_at"), F.ceil(F.col("offset_us") / (seconds * 1_000_000)).cast("long").alias("missing"))


def continuity_gaps(seen: DataFrame, new: DataFrame, seconds: int, history_limit: int) -> DataFrame:
    """Gaps between the last bar seen of each series and the first new one; series without history have none."""
    last = seen.groupBy("series_key").agg(F.max("opened_at").alias("last"))
    first = new.groupBy("series_key").agg(F.min("opened_at").alias("actual_at"))
    out = last.join(first, "series_key").withColumn("expected_at", F.col("last") + F.expr(f"INTERVAL {seconds} SECONDS")).where("actual_at > expected_at")
    missing = F.ceil((_micros(F.col("actual_at")) - _micros(F.col("expected_at"))) / (seconds * 1_000_000)).cast("long")
    return out.select("series_key", "expected_at", "actual_at", missing.alias("missing"), (missing <= history_limit).alias("recoverable"))


def freshness(bars: DataFrame, observed_at: Column, seconds: int, stale_after: int = 3) -> DataFrame:
    """Age of each series' newest close at observed_at: fresh, stale, or from the future."""
    out = bars.groupBy("series_key").agg(F.max("closed_at").alias("newest_close"))
    age = (_micros(observed_at) - _micros(F.col("newest_close"))) / 1_000_000
    return out.withColumn("age_seconds", age).withColumn("state", F.when(age < 0, "future").when(age > stale_after * seconds, "stale").otherwise("fresh"))


def conditions(audit: DataFrame, gaps: DataFrame, fresh: DataFrame) -> DataFrame:
    """One row for each condition met: event_id, series_key, code, severity, detail, seen_at is left to the caller."""
    counters = {"duplicates_removed": "data_duplicates_removed", "trimmed": "data_rows_trimmed", "missing_dropped": "data_missing_rows_dropped", "rejected": "data_malformed"}
    pairs = F.array(*[F.struct(F.lit(code).alias("code"), F.col(c).cast("long").alias("n")) for c, code in counters.items()])
    one = audit.select("series_key", F.explode(pairs).alias("p")).where("p.n > 0").select("series_key", "p.code", F.col("p.n").cast("string").alias("detail"))
    two = gaps.select("series_key", F.lit("data_gap").alias("code"), F.date_format("expected_at", "yyyy-MM-dd HH:mm:ss").alias("detail"))
    three = fresh.where("state <> 'fresh'").select("series_key", F.when(F.col("state") == "stale", "data_stale").otherwise("data_future_timestamp").alias("code"), F.lit("").alias("detail"))
    out = one.unionByName(two).unionByName(three)
    severity = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return out.withColumn("severity", severity[F.col("code")]).withColumn("event_id", identity("severity", "code", "series_key", "detail"))


def aggregated(events: DataFrame, seen_at: str = "seen_at") -> DataFrame:
    """Count, first and last sight of each event."""
    return events.groupBy("event_id").agg(F.count("*").alias("count"), F.min(seen_at).alias("first_seen"), F.max(seen_at).alias("last_seen"))


def merged_aggregates(*parts: DataFrame) -> DataFrame:
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("event_id").agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def rollup(components: DataFrame, events: DataFrame) -> DataFrame:
    """(component, state) for each component, UNKNOWN where none observed it; events(component, severity), INFO changes nothing."""
    rank = F.when(F.col("severity") == "CRITICAL", 3).when(F.col("severity") == "WARNING", 2).when(F.col("severity") == "INFO", 0)
    worst = events.groupBy("component").agg(F.max(rank).alias("r"))
    state = F.element_at(F.array(*[F.lit(s) for s in RANK]), F.coalesce("r", F.lit(1)).cast("int") + 1)
    return components.join(worst, "component", "left").select("component", state.alias("state"))


def overall(states: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in RANK]), F.col("state"))
    return states.agg(F.max(rank).alias("r")).select(F.element_at(F.array(*[F.lit(s) for s in RANK]), F.col("r").cast("int")).alias("state"))


def durations(df: DataFrame, micros: Column, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(micros).alias("n"), F.sum(micros).alias("total"), F.min(micros).alias("low"), F.max(micros).alias("high"), F.avg(micros).alias("average"))
