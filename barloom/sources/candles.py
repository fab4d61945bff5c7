"""Candle tables from files, landed kline pages and event tables; checks, cleaning and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import chunks
from barloom.functions.core import PRICE, TIMEFRAMES, close_time, require_higher_multiple

FIELDS = ("timestamp", "open", "high", "low", "close", "volume")
RAW = T.StructType([T.StructField(c, T.StringType()) for c in FIELDS])
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
MISSING = ("", "nan", "null", "none")


def read_csv(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The six text fields of CSV files whose header names them in any order."""
    if streaming:
        return spark.readStream.schema(RAW).option("header", True).option("enforceSchema", False).csv(path)
    found = spark.read.option("header", True).option("inferSchema", False).csv(path)
    names = {c.lstrip("\ufeff"): c for c in found.columns}
    if set(names) != set(FIELDS):
        raise ValueError(f"columns {sorted(names)} are not {sorted(FIELDS)}")
    return found.select(*[F.col(f"`{names[c]}`").alias(c) for c in FIELDS])


def read_klines(spark: SparkSession, path: str, cutoff_ms: int) -> DataFrame:
    """The six text fields of landed kline pages (JSON arrays of 12-field arrays), closed bars only."""
    page = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<array<string>>")).alias("k"))
    k = F.col("k")
    closed = page.where(F.element_at(k, 7).cast("long") < cutoff_ms)
    return closed.select(*[F.element_at(k, i + 1).alias(c) for i, c in enumerate(FIELDS)])


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c)).isin(*MISSING)


def parsed(raw: DataFrame) -> DataFrame:
    """Typed fields with missing (any field) and reject_reason (null: sound) for every row of text fields."""
    t = F.trim("timestamp")
    zoned = t.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:?\d\d)$")
    when = F.when(t.rlike(r"^\d+$"), F.expr("timestamp_millis(try_cast(trim(timestamp) AS BIGINT))")).when(zoned, F.try_to_timestamp(t))
    out = raw
    for c in FIELDS[1:]:
        out = out.withColumn(c + "_value", F.when(F.trim(c).rlike(NUMBER), F.expr(f"try_cast(trim({c}) AS {PRICE})")))
    out = out.withColumn("opened_at", F.when(~is_missing(F.col("timestamp")), when))
    prices = [F.col(c + "_value") for c in FIELDS[1:5]]
    missing = F.array_compact(F.array(*[F.when(is_missing(F.col(c)), F.lit(c)) for c in FIELDS]))
    bad = F.when(~is_missing(F.col("timestamp")) & F.col("opened_at").isNull(), "timestamp")
    for c in FIELDS[1:]:
        bad = bad.when(~is_missing(F.col(c)) & F.col(c + "_value").isNull(), c)
    bad = bad.when(F.least(*prices) <= 0, "price not above zero").when(F.col("volume_value") < 0, "volume below zero")
    # greatest and least skip nulls, so a row that lacks a field is still held to its others
    bad = bad.when(F.col("high_value") < F.greatest("open_value", "low_value", "close_value"), "high too low")
    bad = bad.when(F.col("low_value") > F.least("open_value", "high_value", "close_value"), "low too high")
    out = out.withColumn("missing", F.size(missing) > 0).withColumn("reject_reason", bad)
    keys = [c for c in raw.columns if c not in FIELDS]
    return out.select(*keys, "opened_at", *[F.col(c + "_value").alias(c) for c in FIELDS[1:]], "missing", "reject_reason")


def cleaned(rows: DataFrame, policy: str = "error", missing: str = "drop", history_limit: int | None = None, keys: tuple[str, ...] = ("series_key",)) -> tuple[DataFrame, DataFrame]:
    """(candles, rejects) of parsed rows.

    policy or missing "error" fail on the first such row; "quarantine" and "drop" leave it out.
    Equal rows of one time are one; rows of one time that differ are all rejected as a conflict
    (or fail), never the first kept. The history limit counts after all checks.
    """
    if policy == "error":
        rows = rows.withColumn("reject_reason", F.when(F.col("reject_reason").isNotNull(), F.raise_error(F.concat(F.lit("malformed candle: "), "reject_reason"))))
    if missing == "error":
        rows = rows.withColumn("missing", F.when(F.col("missing"), F.raise_error(F.lit("missing value")).cast("boolean")).otherwise(False))
    rejects = rows.where("reject_reason IS NOT NULL OR missing").withColumn("reject_reason", F.coalesce("reject_reason", F.lit("missing")))
    values = F.struct(*FIELDS[1:])
    sound = rows.where("reject_reason IS NULL AND NOT missing")
    one = sound.groupBy(*keys, "opened_at").agg(F.count("*").alias("copies"), F.min(values).alias("a"), F.max(values).alias("b"))
    if policy == "error":
        one = one.withColumn("a", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.raise_error(F.lit("conflicting candles")).cast(sound.select(values.alias("v")).schema["v"].dataType)))
    conflicts = one.where("a <> b").select(*keys, "opened_at", F.lit("conflict").alias("reject_reason"))
    candles = one.where("a = b").select(*keys, "opened_at", "a.*", "copies")
    if history_limit is not None:
        candles = latest(candles, history_limit, keys)
    return candles, rejects.select(*keys, "opened_at", "reject_reason").unionByName(conflicts)


def latest(candles: DataFrame, limit: int, keys: tuple[str, ...] = ("series_key",)) -> DataFrame:
    """The last `limit` candles of every series."""
    newest = Window.partitionBy(*keys).orderBy(F.desc("opened_at"))
    return candles.withColumn("newest", F.row_number().over(newest)).where(F.col("newest") <= limit).drop("newest")


def audit(rows: DataFrame, history_limit: int | None = None, order: str | None = None) -> DataFrame:
    """Counters of the cleaning of each series: what came in, what was left out and why, whether order changed."""
    sound = F.col("reject_reason").isNull() & ~F.col("missing")
    counts = rows.groupBy("series_key").agg(
        F.count("*").alias("input_rows"), F.count_if(F.col("missing")).alias("missing_dropped"),
        F.count_if(F.col("reject_reason").isNotNull() & ~F.col("missing")).alias("rejected"), F.count_if(sound).alias("sound"),
    )
    times = rows.where(sound).groupBy("series_key", "opened_at").agg(F.count("*").alias("n")).groupBy("series_key").agg(F.count("*").alias("distinct_times"))
    out = counts.join(times, "series_key", "left").withColumn("distinct_times", F.coalesce("distinct_times", F.lit(0)))
    kept = F.least("distinct_times", F.lit(history_limit)) if history_limit is not None else F.col("distinct_times")
    out = out.withColumn("output_rows", kept).withColumn("duplicates_removed", F.col("sound") - F.col("distinct_times")).withColumn("trimmed", F.col("distinct_times") - F.col("output_rows"))
    if order:
        back = rows.where(sound).withColumn("back", F.col("opened_at") < F.lag("opened_at").over(Window.partitionBy("series_key").orderBy(order)))
        out = out.join(back.groupBy("series_key").agg(F.coalesce(F.bool_or("back"), F.lit(False)).alias("reordered")), "series_key", "left")
    return out.drop("sound", "distinct_times")


def spans(time: str, timeframe: str) -> Column:
    """The span of a timeframe that holds a time; weeks open on Mondays."""
    return F.window(time, f"{TIMEFRAMES[timeframe]} seconds", startTime="-3 days" if timeframe == "1w" else "0 seconds")


def rolled(bars: DataFrame, timeframe: str) -> DataFrame:
    """Bars of a longer timeframe from those of a shorter one that divides it: the same as from the events, which need not be read again."""
    own = bars.select("timeframe").first()
    if own is not None:
        require_higher_multiple(own[0], timeframe)
    return (
        bars.groupBy("symbol", spans("opened_at", timeframe).alias("w"))
        .agg(F.min_by("open", "opened_at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "opened_at").alias("close"), F.sum("volume").cast(PRICE).alias("volume"), F.sum("trades").alias("trades"))
        .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("w.start").alias("opened_at"), "open", "high", "low", "close", "volume", "trades")
    )


def bars_from_events(events: DataFrame, timeframe: str, symbol: Column, ts: Column, price: Column, volume: Column, order: list[Column]) -> DataFrame:
    """Open, high, low, close, volume and count of each symbol and time span that has events of a price above zero."""
    rows = events.select(symbol.alias("symbol"), ts.cast("timestamp").alias("ts"), price.cast(PRICE).alias("price"), volume.cast(PRICE).alias("volume"), F.struct(ts, *order).alias("o")).where("price > 0")
    return (
        rows.groupBy("symbol", spans("ts", timeframe).alias("w"))
        .agg(F.min_by("price", "o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "o").alias("close"), F.sum("volume").cast(PRICE).alias("volume"), F.count("*").alias("trades"))
        .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("w.start").alias("opened_at"), "open", "high", "low", "close", "volume", "trades")
    )


def in_order(first: str, then: str) -> Column:
    """A long and an int column as one number that sorts as they do, nulls first; unlike a struct of them it needs no sort in aggregates."""
    long = F.coalesce(F.col(first).cast("decimal(20,0)"), F.lit("-9223372036854775809").cast("decimal(20,0)"))
    return long * F.lit(10**10).cast("decimal(11,0)") + F.coalesce(F.col(then).cast("decimal(10,0)"), F.lit("-2147483649").cast("decimal(10,0)"))


def bars_from_moments(events: DataFrame, timeframe: str, symbol: Column, ts: Column, price: Column, volume: Column, order: Column) -> DataFrame:
    """bars_from_events of many events at few times, days for example: first by time, then by span; order: a number, by which events of one time are sorted."""
    rows = events.select(symbol.alias("symbol"), ts.cast("timestamp").alias("ts"), price.cast(PRICE).alias("price"), volume.cast(PRICE).alias("volume"), order.alias("o")).where("price > 0")
    times = rows.groupBy("symbol", "ts").agg(F.min_by("price", "o").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "o").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("trades"))
    return (
        times.groupBy("symbol", spans("ts", timeframe).alias("w"))
        .agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").cast(PRICE).alias("volume"), F.sum("trades").alias("trades"))
        .select("symbol", F.lit(timeframe).alias("timeframe"), F.col("w.start").alias("opened_at"), "open", "high", "low", "close", "volume", "trades")
    )


def as_series(candles: DataFrame, timeframe: str, venue: str = "local", provider: str = "events", dataset: str = "default", chunk_bars: int | None = None) -> DataFrame:
    """Add the series' identity, bar_index, closed_at and available_at (the close, or a later arrival).

    chunk_bars: bars numbered in one task; without it a task numbers a whole series.
    """
    closed = close_time(F.col("opened_at"), timeframe)
    out = candles.withColumn("series_key", F.concat_ws(":", "symbol", F.lit(timeframe), F.lit(venue), F.lit(provider), F.lit(dataset)))
    arrived = F.col("arrived_at") if "arrived_at" in candles.columns else F.lit(None).cast("timestamp")
    out = out.withColumn("closed_at", closed).withColumn("available_at", F.coalesce(F.greatest(arrived, closed), closed))
    if chunk_bars:
        return chunks.numbered(out, chunk_bars * TIMEFRAMES.get(timeframe, 30 * TIMEFRAMES["1d"]))
    return out.withColumn("bar_index", (F.row_number().over(Window.partitionBy("series_key").orderBy("opened_at")) - 1).cast("long"))


def overlaps(bars: DataFrame) -> DataFrame:
    """Bars that open before the one before them closed."""
    before = F.lag("closed_at").over(Window.partitionBy("series_key").orderBy("bar_index"))
    return bars.withColumn("before", before).where("opened_at < before").drop("before")


def union_series(*tables: DataFrame) -> DataFrame:
    """All tables as one; a series that two of them hold is an error."""
    tagged = [t.withColumn("source_table", F.lit(i)) for i, t in enumerate(tables)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    twice = both.groupBy("series_key").agg(F.count_distinct("source_table").alias("n")).where("n > 1").select("series_key").limit(1).collect()
    if twice:
        raise ValueError(f"series {twice[0][0]} is given twice")
    return both.drop("source_table")


def records(bars: DataFrame) -> DataFrame:
    """One lossless canonical JSON record per candle, partition columns beside it."""
    text = [F.col(c).cast("string").alias(c) for c in ("close", "high", "low", "open")]
    stamp = F.date_format("opened_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")
    return bars.select("symbol", "timeframe", F.to_date("opened_at").alias("date"), F.to_json(F.struct(*text, stamp, F.col("volume").cast("string").alias("volume"))).alias("record"))


def write_records(bars: DataFrame, path: str, fmt: str = "parquet") -> None:
    records(bars).write.partitionBy("symbol", "timeframe", "date").format(fmt).save(path)
