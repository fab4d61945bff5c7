"""Scores, votes, eligibility and published signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.core import identity
from barloom.plans.config import Config

# Points of each component, and the reason given for it.
MTF = {"BULLISH": 15, "BEARISH": 15, "NEUTRAL": 8, "MIXED": 5, "INSUFFICIENT_CONTEXT": 0}
PD = {"DISCOUNT": 8, "EQUILIBRIUM": 5, "PREMIUM": 3, "OUTSIDE_RANGE": 1, "INSUFFICIENT_CONTEXT": 0}
OTE = {"INSIDE_OTE": 7, "BELOW_OTE": 3, "ABOVE_OTE": 3, "INSUFFICIENT_CONTEXT": 0}
HALAL, DISPLACEMENT, SWEEP, GAP, BLOCK = 10, 12, 10, 8, 10
MTF_SAID = {"BULLISH": "mtf_directional", "BEARISH": "mtf_directional", "NEUTRAL": "mtf_neutral", "MIXED": "mtf_mixed"}
PD_SAID = {"DISCOUNT": "pd_discount", "EQUILIBRIUM": "pd_equilibrium", "PREMIUM": "pd_premium", "OUTSIDE_RANGE": "pd_outside_range"}
OTE_SAID = {"INSIDE_OTE": "ote_inside", "BELOW_OTE": "ote_below", "ABOVE_OTE": "ote_above"}
COMPONENTS = 11


def by_value(column: Column, table: dict[str, object], other: object) -> Column:
    out = F
    for value, x in table.items():
        out = out.when(column == value, x)
    return out.otherwise(other)


def add_scores(df: DataFrame, cfg: Config) -> DataFrame:
    """score_<component>, score, passed and score_reasons, one reason for each of the eleven components in order.

    Nothing scores for symbols that are not listed; structure shifts, breakers and mitigations have a weight but never score.
    """
    ok = F.col("status") == "HALAL"
    parts = {
        "halal": F.lit(HALAL), "mtf": by_value(F.col("confluence"), MTF, 0), "displacement": F.when(F.col("displacement").isNotNull(), DISPLACEMENT).otherwise(0),
        "sweep": F.when(F.col("sweeps").isNotNull(), SWEEP).otherwise(0), "fvg": F.when(F.col("gap").isNotNull(), GAP).otherwise(0),
        "order_block": F.when(F.col("block").isNotNull(), BLOCK).otherwise(0), "pd": by_value(F.col("pd_class"), PD, 0), "ote": by_value(F.col("ote_position"), OTE, 0),
    }
    out = df.withColumns({f"score_{k}": F.when(ok, v).otherwise(0) for k, v in parts.items()})
    total = sum((F.col(f"score_{k}") for k in parts), F.lit(0))
    missing = F.lit("missing_evidence")

    def there(column: str, reason: str) -> Column:
        return F.when(F.col(column).isNotNull(), reason).otherwise(missing)

    reasons = F.array(
        F.lit("halal_status"), by_value(F.col("confluence"), MTF_SAID, "mtf_insufficient"), missing, there("displacement", "displacement_present"), there("sweeps", "sweep_present"), there("gap", "fvg_present"),
        there("block", "order_block_present"), missing, missing, by_value(F.col("pd_class"), PD_SAID, "pd_insufficient"), by_value(F.col("ote_position"), OTE_SAID, "ote_insufficient"),
    )
    gate = F.array_repeat(F.when(F.col("status") == "HARAM", "gated_haram").otherwise("gated_unknown"), COMPONENTS)
    return out.withColumn("score", total).withColumn("score_reasons", F.when(ok, reasons).otherwise(gate)).withColumn("passed", ok & (F.col("score") >= cfg.score_threshold))


def add_votes(df: DataFrame) -> DataFrame:
    """votes (source, bias, reason), bias, eligibility and its reasons.

    A vote without a bias abstains and says why. A mixed higher timeframe or votes on both sides
    leave the bias NEUTRAL; symbols that are not listed are NEUTRAL with one reason.
    """

    def vote(source: str, *cases: tuple[Column, str | None, str], other: str | None = None) -> Column:
        out = F
        for test, bias, reason in cases:
            out = out.when(test, F.struct(F.lit(source).alias("source"), F.lit(bias).cast("string").alias("bias"), F.lit(reason).alias("reason")))
        return out.otherwise(F.struct(F.lit(source).alias("source"), F.lit(None).cast("string").alias("bias"), F.lit(other).alias("reason"))) if other else out

    long, short = "LONG_BIAS", "SHORT_BIAS"
    mtf, trend, block = F.col("confluence"), F.col("trend"), F.col("block")
    inside = F.col("ote_position") == "INSIDE_OTE"
    votes = F.filter(F.array(
        vote("mtf", (mtf == "BULLISH", long, "mtf_long"), (mtf == "BEARISH", short, "mtf_short"), (mtf == "MIXED", None, "mtf_mixed"), (mtf == "NEUTRAL", None, "mtf_neutral"), other="mtf_insufficient"),
        vote("structure", (~F.coalesce("ready", F.lit(False)), None, "structure_unready"), (trend == "bullish", long, "structure_long"), (trend == "bearish", short, "structure_short"), other="structure_ranging"),
        vote("structure_event", (F.col("event_up").isNotNull(), long, "structure_event_long")), vote("structure_event", (F.col("event_down").isNotNull(), short, "structure_event_short")),
        vote("order_block", (block == "bullish", long, "order_block_long"), (block == "bearish", short, "order_block_short"), other="order_block_missing"),
        vote("ote", (inside & (F.col("range_direction") == "bullish"), long, "ote_long"), (inside & (F.col("range_direction") == "bearish"), short, "ote_short"), other="ote_missing"),
        *[vote(k, (F.lit(True), None, f"{k}_missing")) for k in ("mss", "breaker", "mitigation")],
    ), lambda v: v.isNotNull())
    out = df.withColumn("votes", votes)
    listed = F.col("status") == "HALAL"
    said = F.transform("votes", lambda v: F.coalesce(v["bias"], F.lit("")))
    up, down = F.array_contains(said, long), F.array_contains(said, short)
    mixed = F.col("confluence") == "MIXED"
    bias = F.when(~listed | mixed | (up & down), "NEUTRAL").when(up, long).when(down, short).otherwise("NEUTRAL")
    out = out.withColumn("bias", bias).withColumn("eligibility", F.when(listed & F.col("passed"), "ELIGIBLE").otherwise("NOT_ELIGIBLE"))
    gate = F.array(F.when(F.col("status") == "HARAM", "gated_haram").otherwise("gated_unknown"))
    head = F.array(F.when(F.col("passed"), "halal_and_threshold").otherwise("threshold_not_met"))
    closing = F.when(F.col("bias") != "NEUTRAL", F.array().cast("array<string>")).when(mixed | (up & down), F.array(F.lit("conflicting_evidence"))).otherwise(F.array(F.lit("no_directional_evidence")))
    reasons = F.array_distinct(F.concat(head, F.transform("votes", lambda v: v["reason"]), closing))
    return out.withColumn("eligibility_reasons", F.when(listed, reasons).otherwise(gate))


def add_signals(df: DataFrame, cfg: Config, published: DataFrame | None = None) -> DataFrame:
    """signal, direction, setup_id and reasons; only the first BUY of a setup in a series is published.

    published: (series_key, setup_id) of setups that earlier bars than these have published.
    """
    cursors = [F.col(f"cursor_{tf}") for tf in cfg.higher]
    ids = [
        *cursors, F.when(F.col("ote_low").isNotNull(), F.concat_ws("|", "range_low", "range_high", "range_confirm")).alias("ote"),
        F.when(F.col("block").isNotNull(), F.col("bar_index")).alias("blk"), F.when(F.col("gap").isNotNull(), F.col("bar_index")).alias("gp"), F.when(F.col("displacement").isNotNull(), F.col("bar_index")).alias("dsp"),
    ]
    able = (F.col("status") == "HALAL") & (F.col("eligibility") == "ELIGIBLE")
    candidate = F.when(~able, "NO_SIGNAL").when(F.col("bias") == "SHORT_BIAS", "BEARISH_AVOID").when(F.col("bias") == "LONG_BIAS", "BUY_SIGNAL").otherwise("NO_SIGNAL")
    out = df.withColumn("candidate", candidate).withColumn("setup_id", identity("symbol", "timeframe", "bias", *ids))
    order = Window.partitionBy("series_key", "candidate", "setup_id").orderBy("bar_index")
    out = out.withColumn("again", (F.col("candidate") == "BUY_SIGNAL") & (F.row_number().over(order) > 1))
    if published is not None:
        out = out.join(published.select("series_key", "setup_id", F.lit(True).alias("known")), ["series_key", "setup_id"], "left")
        out = out.withColumn("again", F.col("again") | ((F.col("candidate") == "BUY_SIGNAL") & F.coalesce("known", F.lit(False)))).drop("known")
    out = out.withColumn("signal", F.when(F.col("again"), "NO_SIGNAL").otherwise(F.col("candidate")))
    buy = F.filter(F.array(
        F.lit("halal_asset"), F.lit("sqs_threshold_passed"), F.lit("long_bias"), F.when(F.col("confluence") == "BULLISH", "mtf_alignment"), F.when(F.col("displacement") == "bullish", "bullish_displacement"),
        F.when(F.col("pd_class") == "DISCOUNT", "discount_context"), F.when(F.col("ote_position") == "INSIDE_OTE", "ote_context"),
    ), lambda r: r.isNotNull())
    no = F.array(F.when(F.col("status") != "HALAL", "not_halal").when(~F.col("passed"), "sqs_below_threshold").when(F.col("bias") == "NEUTRAL", "neutral_bias").otherwise("missing_required_evidence"))
    avoid = F.array(F.lit("halal_asset"), F.lit("sqs_threshold_passed"), F.lit("bearish_spot_avoid"))
    reasons = F.when(F.col("again"), F.array(F.lit("duplicate_setup"))).when(F.col("signal") == "BUY_SIGNAL", buy).when(F.col("signal") == "BEARISH_AVOID", avoid).otherwise(no)
    out = out.withColumn("reasons", reasons).withColumn("direction", F.when(F.col("signal") == "BUY_SIGNAL", "LONG"))
    return out.withColumn("signal_id", F.when(F.col("signal") == "BUY_SIGNAL", identity("series_key", "bar_index", "setup_id"))).drop("again", "candidate")


def add_labels(df: DataFrame) -> DataFrame:
    """labels and their combination, from what is on this bar; in a fixed order."""
    tests = [
        ("bullish_displacement", F.col("displacement") == "bullish"), ("sweep_associated", F.col("displacement").isNotNull() & (F.col("sweep_context") != "none")),
        ("fvg_bullish", F.col("gap") == "bullish"), ("fvg_bearish", F.col("gap") == "bearish"), ("order_block_bullish", F.col("block") == "bullish"), ("order_block_bearish", F.col("block") == "bearish"),
        ("inside_ote", F.col("ote_position") == "INSIDE_OTE"), ("pd_discount", F.col("pd_class") == "DISCOUNT"), ("pd_premium", F.col("pd_class") == "PREMIUM"), ("pd_equilibrium", F.col("pd_class") == "EQUILIBRIUM"),
        ("mtf_bullish", F.col("confluence") == "BULLISH"), ("mtf_mixed", F.col("confluence") == "MIXED"),
    ]
    labels = F.filter(F.array(*[F.when(t, name) for name, t in tests]), lambda x: x.isNotNull())
    out = df.withColumn("labels", labels)
    return out.withColumn("combination", F.coalesce(F.nullif(F.concat_ws("+", "labels"), F.lit("")), F.lit("no_labels")))
