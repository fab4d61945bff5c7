"""Reports over signals with outcomes: performance, months, walk-forward, cells, comparison, charts, ledger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.core import identity
from barloom.operators.outcomes import outcome_aggregates
from barloom.plans.config import Config


def signal_rows(facts: DataFrame) -> DataFrame:
    """One row per published BUY."""
    month = F.date_format("opened_at", "yyyy-MM")
    return facts.where("signal = 'BUY_SIGNAL'").select(
        "signal_id", "series_key", "symbol", "timeframe", "bar_index", "opened_at", month.alias("month"), "score", "labels", "combination", "regime", "close", "outcome", "final_return", "mfe_return", "mae_return"
    )


def buckets(rows: DataFrame, dimensions: dict[str, str], cfg: Config) -> DataFrame:
    """Aggregates by each dimension and over all, in one pass of grouping sets."""
    groups = [F.coalesce(F.col(c), F.lit("unclassified")).alias(d) for d, c in dimensions.items()]
    base = rows.select(*groups, "outcome", "final_return", "mfe_return", "mae_return")
    names = list(dimensions)
    out = base.groupingSets([[], *[[F.col(n)] for n in names]], *names).agg(*outcome_aggregates(), F.grouping_id(*names).alias("gid"))
    name, group = F.when(F.col("gid") == 2 ** len(names) - 1, "overall"), F
    for i, n in enumerate(names):
        only = F.col("gid") == (2 ** len(names) - 1) - 2 ** (len(names) - 1 - i)
        name, group = name.when(only, n), group.when(only, F.col(n))
    out = out.withColumns({"dimension": name, "group": group.otherwise(F.lit("all")), "sufficient": F.col("finalized") >= cfg.minimum_finalized})
    return out.drop("gid", *names)


def performance(rows: DataFrame, cfg: Config) -> DataFrame:
    """Buckets over all, by symbol, timeframe, month and combination, and by each label a signal has."""
    main = buckets(rows, {"symbol": "symbol", "timeframe": "timeframe", "month": "month", "combination": "combination"}, cfg)
    labels = rows.select(F.explode("labels").alias("label"), "outcome", "final_return", "mfe_return", "mae_return").groupBy(F.col("label").alias("group")).agg(*outcome_aggregates())
    labels = labels.withColumns({"dimension": F.lit("label"), "sufficient": F.col("finalized") >= cfg.minimum_finalized})
    return main.unionByName(labels)


def ranked(report: DataFrame, dimension: str) -> DataFrame:
    """The best and worst sufficient group of a dimension by average return; ties keep the first by name."""
    rows = report.where((F.col("dimension") == dimension) & F.col("sufficient"))
    return rows.agg(F.min(F.struct(-F.col("avg_return"), F.col("group").alias("name"))).alias("b"), F.min(F.struct("avg_return", F.col("group").alias("name"))).alias("w")).select(F.col("b.name").alias("best"), F.col("w.name").alias("worst"))


def duplicated_signals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("signal_id").agg(F.count_distinct("series_key").alias("n")).where("n > 1")


def monthly_review(rows: DataFrame, cfg: Config) -> DataFrame:
    """Each month against the one before it that has signals; differences only between sufficient months."""
    months = rows.groupBy("month").agg(*outcome_aggregates())
    w = Window.orderBy("month")  # one row per month
    before = F.lag(F.struct("month", "win_rate", "avg_return", "finalized")).over(w)
    out = months.withColumn("p", before)
    both = (F.col("finalized") >= cfg.minimum_finalized) & (F.col("p.finalized") >= cfg.minimum_finalized)
    return out.select("month", F.col("p.month").alias("previous"), "total", "finalized", "win_rate", "avg_return", F.when(both, F.col("win_rate") - F.col("p.win_rate")).alias("win_rate_change"), F.when(both, F.col("avg_return") - F.col("p.avg_return")).alias("avg_return_change"))


def window_plan(bars: DataFrame, cfg: Config) -> DataFrame:
    """(series_key, window_id, first, split, last): development then validation bars; incomplete ends are left out."""
    counts = bars.groupBy("series_key").agg(F.count("*").alias("n"))
    size = cfg.development_bars + cfg.validation_bars
    ids = F.sequence(F.lit(0), F.floor((F.col("n") - size) / cfg.step_bars).cast("long"))
    out = counts.where(F.col("n") >= size).select("series_key", F.explode(ids).alias("window_id"))
    start = F.col("window_id") * cfg.step_bars
    return out.select("series_key", "window_id", start.alias("first"), (start + cfg.development_bars).alias("split"), (start + size - 1).alias("last"))


def window_bars(bars: DataFrame, cfg: Config) -> DataFrame:
    """Every window's own bars as a series of their own, indexed from 0; a bar's windows follow from its index."""
    plan = window_plan(bars, cfg)
    size = cfg.development_bars + cfg.validation_bars
    low = F.greatest(F.lit(0), F.ceil((F.col("bar_index") - (size - 1)) / cfg.step_bars).cast("long"))
    high = F.floor(F.col("bar_index") / cfg.step_bars).cast("long")
    held = bars.where(low <= high).withColumn("window_id", F.explode(F.sequence(low, high))).join(plan, ["series_key", "window_id"])
    held = held.withColumn("parent_key", F.col("series_key")).withColumn("series_key", F.concat_ws(":", "series_key", F.concat(F.lit("w"), "window_id")))
    return held.withColumn("bar_index", F.col("bar_index") - F.col("first")).drop("first", "split", "last")


SEGMENTS = ("development", "validation")
COUNTS = ("total", "open", "win", "loss", "flat", "finalized")


def segments(rows: DataFrame, plan: DataFrame, cfg: Config, *keys: str) -> DataFrame:
    """Aggregates by window and segment of every planned window, with signals or none; the status looks at validation."""
    kind = F.when(F.col("bar_index") < cfg.development_bars, "development").otherwise("validation")
    seen = rows.withColumn("segment", kind).groupBy(*keys, "segment").agg(*outcome_aggregates())
    out = plan.select(*keys, F.explode(F.array(*map(F.lit, SEGMENTS))).alias("segment")).join(seen, [*keys, "segment"], "left").fillna(0, list(COUNTS))
    status = F.when(F.col("finalized") < cfg.minimum_finalized, "UNDERSAMPLED").when((F.col("win_rate") >= cfg.stable_win_rate) & (F.col("avg_return") >= 0), "STABLE").otherwise("WEAK")
    return out.withColumn("status", F.when(F.col("segment") == "validation", status))


def degradation(parts: DataFrame, cfg: Config, *keys: str) -> DataFrame:
    """Validation less development of each window."""
    pick = lambda segment, c: F.max(F.when(F.col("segment") == segment, F.col(c)))
    out = parts.groupBy(*keys).agg(*[pick(s, c).alias(f"{s[0]}_{c}") for s in SEGMENTS for c in ("win_rate", "avg_return", "finalized")])
    both = (F.col("d_finalized") >= cfg.minimum_finalized) & (F.col("v_finalized") >= cfg.minimum_finalized)
    return out.select(*keys, (F.col("v_win_rate") - F.col("d_win_rate")).alias("win_rate_change"), (F.col("v_avg_return") - F.col("d_avg_return")).alias("avg_return_change"), F.coalesce(both, F.lit(False)).alias("both"))


def degradation_summary(changes: DataFrame, *keys: str) -> DataFrame:
    """Mean changes over the windows whose two segments are sufficient."""
    mean = lambda c: F.avg(F.when(F.col("both"), F.col(c))).alias(f"mean_{c}")
    return changes.groupBy(*keys).agg(F.count("*").alias("windows"), F.count_if("both").alias("comparable"), mean("win_rate_change"), mean("avg_return_change"))


def stability(parts: DataFrame, cfg: Config, *keys: str) -> DataFrame:
    """Over validation segments: counts, spreads, best and worst window (the first of equals), overall status."""
    rows = parts.where("segment = 'validation'")
    done = F.col("finalized") >= cfg.minimum_finalized
    values = {"win": "win_rate", "return": "avg_return", "mfe": "avg_mfe", "mae": "avg_mae"}
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("windows"), F.count_if(done).alias("sampled"), F.count_if(done & (F.col("avg_return") > 0)).alias("positive"), F.count_if(done & (F.col("avg_return") < 0)).alias("negative"),
        *[(F.max(F.when(done, F.col(c))) - F.min(F.when(done, F.col(c)))).alias(f"{k}_spread") for k, c in values.items()],
        F.min(F.when(done, F.struct(-F.col("avg_return"), "window_id"))).alias("b"), F.min(F.when(done, F.struct("avg_return", "window_id"))).alias("w"),
        F.count_if(F.col("status") == "STABLE").alias("stable"),
    )
    out = out.withColumns({f"{k}_spread": F.when(F.col("sampled") > 1, F.col(f"{k}_spread")) for k in values})
    calm = (F.col("stable") == F.col("sampled")) & (F.col("win_spread").isNull() | (F.col("win_spread") <= cfg.maximum_win_rate_spread))
    status = F.when(F.col("sampled") < cfg.minimum_windows, "UNDERSAMPLED").when(calm, "STABLE").otherwise("WEAK")
    return out.select(*keys, "windows", "sampled", "positive", "negative", *[f"{k}_spread" for k in values], F.col("b.window_id").alias("best"), F.col("w.window_id").alias("worst"), status.alias("status"))


def cells(rows: DataFrame, cfg: Config) -> DataFrame:
    """Cells by setup, symbol, timeframe, month and regime with a pattern, what it says, and their rank where sampled enough."""
    out = buckets(rows, {"setup": "combination", "symbol": "symbol", "timeframe": "timeframe", "month": "month", "regime": "regime"}, cfg)
    enough = F.col("finalized") >= cfg.cell_minimum
    pattern = F.when(~enough, "UNDERSAMPLED").when((F.col("win_rate") >= cfg.strong_win_rate) & (F.col("avg_return") > 0), "WINNER").when((F.col("win_rate") <= cfg.weak_win_rate) & (F.col("avg_return") < 0), "LOSER").otherwise("NEUTRAL")
    order = Window.partitionBy("dimension", enough).orderBy(F.desc("avg_return"), F.desc("win_rate"), "group")
    says = F.when(F.col("pattern") == "WINNER", "STRENGTH").when(F.col("pattern") == "LOSER", "WEAKNESS").otherwise("UNDETERMINED")
    return out.withColumn("pattern", pattern).withColumn("diagnosis", says).withColumn("rank", F.when(enough, F.row_number().over(order)))


def metrics(report: DataFrame) -> DataFrame:
    """One row for each cell and metric."""
    return report.select("dimension", "group", "win_rate", "avg_return", "avg_mfe", "avg_mae", F.col("finalized").alias("sample")).unpivot(["dimension", "group", "sample"], ["win_rate", "avg_return", "avg_mfe", "avg_mae"], "metric", "value")


def scalars(table: DataFrame, dimension: str, group: str, sample: str) -> DataFrame:
    """Like metrics, of a table of degradation or stability: its numbers, one row each; sample: the column of windows that count."""
    numbers = [f.name for f in table.schema.fields if f.name not in (group, sample) and f.dataType.typeName() in ("double", "long", "integer")]
    rows = table.select(F.lit(dimension).alias("dimension"), F.col(group).alias("group"), F.col(sample).alias("sample"), *[F.col(c).cast("double").alias(c) for c in numbers])
    return rows.unpivot(["dimension", "group", "sample"], numbers, "metric", "value")


def compare(baseline: DataFrame, candidate: DataFrame, cfg: Config) -> DataFrame:
    """Metrics side by side; a difference is conclusive where both samples are large enough, and never of degradation or stability.

    baseline and candidate: reports by dimension and group, or their metrics with scalars.
    """
    keys = ["dimension", "group", "metric"]
    a, b = (df if "metric" in df.columns else metrics(df) for df in (baseline, candidate))
    a = a.withColumnsRenamed({"value": "base", "sample": "base_sample"})
    b = b.withColumnsRenamed({"value": "cand", "sample": "cand_sample"})
    out = a.join(b, keys, "full_outer").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("base_sample", "cand_sample")})
    sure = (F.col("base_sample") >= cfg.compare_minimum) & (F.col("cand_sample") >= cfg.compare_minimum) & ~F.col("dimension").isin("degradation", "stability")
    return out.withColumn("difference", F.col("cand") - F.col("base")).withColumn("conclusive", sure)


def findings(report: DataFrame) -> DataFrame:
    """Cells that lose, with a content id and their evidence."""
    out = report.where("pattern = 'LOSER'")
    return out.select(identity("dimension", "group", "pattern").alias("finding_id"), "dimension", "group", "finalized", "win_rate", "avg_return")


def evidence_quality(has_baseline: Column, complete: Column, sample: Column, minimum: int) -> Column:
    return F.when(~has_baseline | ~complete, "INCOMPLETE").when(sample < minimum, "INSUFFICIENT_SAMPLE").otherwise("SUFFICIENT")


def threshold_grid(facts: DataFrame, grid: DataFrame) -> DataFrame:
    """Signals under each threshold of a small grid(variant, threshold): late settings need no second chain."""
    able = facts.where((F.col("status") == "HALAL") & (F.col("bias") == "LONG_BIAS"))
    out = able.join(F.broadcast(grid), F.col("score") >= F.col("threshold"))  # the grid is a handful of settings
    order = Window.partitionBy("variant", "series_key", "setup_id").orderBy("bar_index")
    return out.withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")


def chart(facts: DataFrame, life: DataFrame, cfg: Config, indicators: DataFrame | None = None) -> DataFrame:
    """Primitives of a chart in one long table: levels, zones, markers, text and overlays; end_index where a zone has an end.

    Signals, their scores and outcomes are drawn where facts hold them; indicators (series_key,
    bar_index, ema_<period>) add overlays. A pool is one level, named as it was when it appeared.
    """
    key = [F.col("series_key")]

    def rows(df: DataFrame, kind: str, name: Column | str, at: Column, low: Column, high: Column, end: Column | None = None) -> DataFrame:
        end = F.lit(None) if end is None else end
        return df.select(*key, F.lit(kind).alias("kind"), (F.lit(name) if isinstance(name, str) else name).alias("name"), at.cast("long").alias("bar_index"), end.cast("long").alias("end_index"), low.cast("double").alias("low"), high.cast("double").alias("high"))

    at = F.col("bar_index")
    parts = [
        rows(life, "level", F.when(F.col("side") == "buy_side", "swing_high").otherwise("swing_low"), F.col("created_index"), F.col("price"), F.col("price")),
        rows(facts.where("gap IS NOT NULL"), "zone", F.concat(F.lit("gap_"), "gap"), at, F.col("gap_low"), F.col("gap_high")),
        rows(facts.where("block IS NOT NULL"), "zone", F.concat(F.lit("block_"), "block"), F.col("block_index"), F.col("block_low"), F.col("block_high")),
        rows(life.where("status = 'swept'"), "marker", F.concat(F.lit("sweep_"), "side"), F.col("breach_index"), F.col("extreme"), F.col("extreme")),
        rows(facts.where("displacement IS NOT NULL"), "marker", F.concat(F.lit("displacement_"), "displacement"), at, F.col("close"), F.col("close")),
    ]
    fresh = facts.where("range_confirm = bar_index")  # ranges are drawn by the bar that confirms them
    half = (F.col("range_low") + F.col("range_high")) / 2
    parts += [
        rows(fresh, "zone", "dealing_range", F.least("last_low.pivot", "last_high.pivot"), F.col("range_low"), F.col("range_high"), F.greatest("last_low.pivot", "last_high.pivot")),
        rows(fresh, "level", "equilibrium", at, half, half),
        rows(fresh, "zone", F.concat(F.lit("retracement_"), "range_direction"), at, F.col("ote_low"), F.col("ote_high")),
        rows(facts.where("now_tr IS NOT NULL"), "overlay", "atr", at, F.col("now_tr").cast("double") / cfg.atr_period, F.col("now_tr").cast("double") / cfg.atr_period),
    ]
    if "signal" in facts.columns:
        bought = facts.where("signal = 'BUY_SIGNAL'")
        parts.append(rows(bought, "marker", "buy_signal", at, F.col("close"), F.col("close")))
        parts.append(rows(bought, "text", F.concat(F.lit("score "), F.col("score").cast("string")), at, F.col("close"), F.col("close")))
        if "outcome" in facts.columns:
            parts.append(rows(bought.where("outcome <> 'OPEN'"), "marker", F.concat(F.lit("outcome_"), F.lower("outcome")), at + cfg.horizon, F.col("final_close"), F.col("final_close")))
    if indicators is not None:
        parts += [rows(indicators.where(F.col(n).isNotNull()), "overlay", n, at, F.col(n), F.col(n)) for n in (f"ema_{p}" for p in cfg.ema_periods)]
    return reduce(DataFrame.unionByName, parts)


def drawing_order(primitives: DataFrame) -> DataFrame:
    """Primitives of each series in the order in which they are drawn: levels by price, zones by start, markers and text by bar, overlays by bar and name."""
    rank = F.array_position(F.array(*map(F.lit, ("level", "zone", "marker", "text", "overlay"))), F.col("kind"))
    level, overlay = F.col("kind") == "level", F.col("kind") == "overlay"
    return primitives.orderBy("series_key", rank, F.when(~level, F.col("bar_index")), F.when(overlay, F.col("name")), "low", "name", "bar_index", "high")


def price_domain(facts: DataFrame, primitives: DataFrame) -> DataFrame:
    """Lowest and highest price of each series' bars and primitives, overlays and text apart; one apart if they are equal."""
    primitives = primitives.where("kind NOT IN ('overlay', 'text')")
    both = facts.select("series_key", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high")).unionByName(primitives.select("series_key", "low", "high"))
    out = both.groupBy("series_key").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    flat = F.col("low") == F.col("high")
    return out.select("series_key", F.when(flat, F.col("low") - 1).otherwise(F.col("low")).alias("low"), F.when(flat, F.col("high") + 1).otherwise(F.col("high")).alias("high"))


def ledger(observed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per signal, conflicts): observing a signal again changes nothing, a different final outcome is a conflict."""
    done = F.when(F.col("outcome") != "OPEN", F.struct("outcome", "final_return"))
    out = observed.groupBy("signal_id").agg(F.count_distinct(done).alias("n"), F.min("month").alias("month"), F.max(done).alias("final"), *[F.max(F.when(F.col("outcome") != "OPEN", F.col(c))).alias(c) for c in ("mfe_return", "mae_return")])
    rows = out.where("n <= 1").select("signal_id", "month", F.coalesce("final.outcome", F.lit("OPEN")).alias("outcome"), F.col("final.final_return").alias("final_return"), "mfe_return", "mae_return")
    return rows, out.where("n > 1").select("signal_id", "n")


def ledger_stats(rows: DataFrame) -> DataFrame:
    return rows.rollup("month").agg(*outcome_aggregates())
