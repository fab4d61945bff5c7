from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.functions.core import first_hit, first_overlap, overlapping, require_higher_multiple, stretches
from barloom.operators import context, liquidity, outcomes, ranges, signals, structure
from barloom.plans import facts as P
from barloom.plans import queries
from barloom.plans import reports as R
from barloom.plans.config import Config, varied
from barloom.sources import candles, quality
from barloom.streaming.bars import FACTS, Series, late_counts, split_ignored, stream_facts

START = datetime(2024, 1, 1)
# Candles and the events expected of them, as the methods define them.
STRUCTURE = "10,11,9,10 15,16,14,15 12,13,11,12 18,19,17,18 14,15,13,14 16,17,15,16 20,21,19,20 17,18,16,17 12,13,11,12 16,17,15,16 10,11,9,10 14,15,13,14 8,9,7,8 18,19,17,18"
LIQUIDITY = "10,11,9,10 15,16,14,15 12,13,11,12 15,16,14,15 12,13,11,12 12,13,9,10 12,13,11,12 10,13,9,10 12,13,11,12 12,17,11,12 12,13,8,12 12,13,10,12"


def make(spark, rows, minutes=15, timeframe="15m"):
    data = [("S", START + timedelta(minutes=minutes * i), *(float(x) for x in r)) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "symbol string, opened_at timestamp, open double, high double, low double, close double")
    df = df.select("symbol", F.lit(timeframe).alias("timeframe"), "opened_at", *[F.col(c).cast("decimal(18,8)").alias(c) for c in ("open", "high", "low", "close")], F.lit(1).cast("decimal(18,8)").alias("volume"))
    return candles.as_series(df, timeframe)


def text(rows):
    return [r.split(",") for r in rows.split()]


def noise(seed, n=160):
    rng = random.Random(seed)
    price, out = 100.0, []
    for _ in range(n):
        o, c = price, max(5.0, price + rng.randint(-6, 6))
        out.append((o, max(o, c) + rng.randint(0, 3), min(o, c) - rng.randint(0, 3), c))
        price = c
    return out


def test_structure_fixture(spark):
    found = structure.events(P.structure_facts(make(spark, text(STRUCTURE)), Config(fractal_length=3))).orderBy("bar_index").collect()
    assert [(r.bar_index, r.direction, r.event) for r in found] == [(6, "bullish", "BOS"), (8, "bearish", "CHoCH"), (12, "bearish", "BOS"), (13, "bullish", "CHoCH")]


def test_liquidity_fixture(spark):
    cfg = Config(fractal_length=3)
    f = P.structure_facts(make(spark, text(LIQUIDITY)), cfg)
    swept = {(r.side, r.breach_index, float(r.price), float(r.extreme), r.kind) for r in liquidity.pools(f, cfg).where("status = 'swept'").collect()}
    assert swept == {("buy_side", 9, 16.0, 17.0, "equal_highs"), ("sell_side", 10, 9.0, 8.0, "equal_lows")}


def test_active_pools_are_those_after_the_last_bar(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, START + timedelta(minutes=15 * i), kind, 100.0 + rng.randrange(40)) for kind, n in (("click", 700), ("view", 90)) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.symbol, r.side): (r.n, r.top) for r in queries.active_pools(spark, str(tmp_path)).collect()}
    life = liquidity.pools(queries.structured(spark, str(tmp_path)), queries.CFG).where("breach_index IS NULL").collect()
    want = {}
    for r in life:
        n, top = want.get((r.symbol, r.side), (0, 0.0))
        want[r.symbol, r.side] = (n + 1, max(top, float(r.price)))
    assert got == want and any(r.created_index > 500 for r in life)


def test_bands_of_zero_are_exact_pools(spark):
    f = P.structure_facts(make(spark, noise(1)), Config()).persist()
    cols = ["side", "price", "breach_index", "created_index", "touched_index", "members"]
    assert sorted(map(str, liquidity.exact_pools(f).select(cols).collect())) == sorted(map(str, liquidity.banded_pools(f, Config()).select(cols).collect()))


@pytest.mark.parametrize("seed", [2, 3])
def test_prefixes_do_not_change(spark, seed):
    rows, cfg = noise(seed), Config(fractal_length=3)
    cols = ["bar_index", "trend", "event_up", "event_down", "displacement", "gap", "block", "range_status", "pd_class", "ote_position", "shift"]
    full = P.bar_facts(make(spark, rows), cfg).select(cols).where("bar_index < 100").orderBy("bar_index").collect()
    cut = P.bar_facts(make(spark, rows[:100]), cfg).select(cols).orderBy("bar_index").collect()
    assert full == cut


@pytest.mark.parametrize(("block", "levels"), [(8, 3), (4, 3), (4, 2), (256, 3)])
def test_first_hit_across_blocks(spark, block, levels):
    rows = noise(5)
    bars = make(spark, rows)
    for value, above, at in (("high", True, 1), ("low", False, 2)):
        zones = bars.select("series_key", F.col("bar_index").cast("string").alias("zone_id"), F.col("bar_index").alias("start_index"), F.col(value).alias("bound"), F.lit(above).alias("above"))
        got = {int(r.zone_id): r.hit_index for r in first_hit(zones, bars, "high", "low", block=block, levels=levels).collect()}
        v = [r[at] for r in rows]
        beyond = [[j for j in range(i + 1, len(v)) if (v[j] > x if above else v[j] < x)] for i, x in enumerate(v)]
        assert got == {i: js[0] for i, js in enumerate(beyond) if js}


@pytest.mark.parametrize(("block", "levels"), [(4, 3), (8, 2)])
def test_first_overlap_where_the_price_jumps_over_a_zone(spark, block, levels):
    """Bars that jump over a zone leave blocks that reach across it without a hit; by stretches of price none is met in vain."""
    rng = random.Random(9)
    rows = [(x, x + 1, x, x + 1) for x in (rng.choice((10, 20, 30, 40, 50)) + rng.randrange(3) for _ in range(150))]
    bars = make(spark, rows)
    zones = [("S:15m", str(i), i, float(lo), lo + 0.5) for i in range(0, 150, 3) for lo in (11, 16, 25, 32, 44)]
    key = bars.first().series_key
    df = spark.createDataFrame([(key, f"{z[1]}|{z[3]}", *z[2:]) for z in zones], "series_key string, zone_id string, start_index long, zone_low double, zone_high double")
    want = {f"{z[1]}|{z[3]}": next((j for j in range(z[2] + 1, 150) if rows[j][1] > z[3] and rows[j][2] < z[4]), None) for z in zones}
    want = {k: v for k, v in want.items() if v is not None}
    assert 0 < len(want) < len(zones)
    for most, sure in ((32, True), (2, False), (1, False)):
        assert {r.zone_id: r.hit_index for r in first_overlap(df, bars, block=block, levels=levels, most=most).collect()} == want
        unsure = overlapping(df, bars, block, levels, most)[0].where("c0 IS NULL AND c1 IS NOT NULL").count()
        assert (unsure == 0) == sure


def test_stretches_of_price(spark):
    """The union of spans: touching ones stay apart, those inside others vanish, and the widest gaps are kept."""
    cases = [[(1, 3), (2, 4), (4, 5)], [(1, 9), (2, 3), (2, 2)], [(2, 2), (2, 2)], [(1, 2), (3, 4), (9, 10), (4.5, 5), (20, 21)], [(7, 8)]]
    df = spark.createDataFrame([(i, [(float(a), float(b)) for a, b in c]) for i, c in enumerate(cases)], "i int, spans array<struct<low:double,high:double>>")

    def got(most):
        return [[tuple(x) for x in r.u] for r in df.select("i", stretches(F.col("spans"), most).alias("u")).orderBy("i").collect()]

    assert got(9) == [[(1, 4), (4, 5)], [(1, 9)], [(2, 2), (2, 2)], [(1, 2), (3, 4), (4.5, 5), (9, 10), (20, 21)], [(7, 8)]]
    assert got(3)[3] == [(1, 5), (9, 10), (20, 21)] and got(1) == [[(1, 5)], [(1, 9)], [(2, 2)], [(1, 21)], [(7, 8)]]


def test_breakers_and_mitigations_bar_by_bar(spark):
    f = P.bar_facts(make(spark, noise(8, 400)), Config(fractal_length=3, min_range_atr=1.0, min_body_atr=0.5)).persist()
    rows = [r.asDict() for r in f.orderBy("bar_index").collect()]
    blocks = [r for r in rows if r["block"]]
    assert blocks
    want_b, want_m = {}, {}
    for b in blocks:
        lo, hi, up = b["block_low"], b["block_high"], b["block"] == "bullish"
        hit = next((r for r in rows if r["bar_index"] > b["bar_index"] and (r["close"] < lo if up else r["close"] > hi)), None)
        if hit:
            want_b[b["bar_index"]] = hit["bar_index"]
        touch = next((r for r in rows if r["bar_index"] > b["bar_index"] and r["high"] > lo and r["low"] < hi), None)
        if touch:
            want_m[b["bar_index"]] = touch["bar_index"]
    broken = liquidity.breakers(f).collect()
    assert {r.published_index: r.hit_index for r in broken} == want_b
    early = {r.published_index for r in broken if r.breaker and r.hit_index <= want_m.get(r.published_index, 1 << 40)}
    assert {r.published_index: r.hit_index for r in liquidity.mitigations(f).collect()} == {k: v for k, v in want_m.items() if k not in early}


def test_mitigation_waits_until_the_block_is_known(spark):
    """A late arrival doesn't lose the mitigation: the first bar that opens when the block is known counts."""
    rows = [(0, 10, 12, 9, "bullish", 9.0, 12.0), (1, 20, 21, 10, None, None, None), (2, 20, 22, 19, None, None, None), (3, 20, 21, 11, None, None, None)]
    at = lambda i: START + timedelta(minutes=15 * i)
    data = [("k", "S", i, at(i), at(i + (2 if i == 0 else 1)), float(c), float(c), float(h), float(lo), None, None, None, b, x, y) for i, c, h, lo, b, x, y in rows]
    f = spark.createDataFrame(data, "series_key string, symbol string, bar_index long, opened_at timestamp, available_at timestamp, close double, prev_close double, high double, low double, displacement string, shift string, open double, block string, block_low double, block_high double")
    assert [(r.hit_index, r.overlap_low, r.overlap_high) for r in liquidity.mitigations(f).collect()] == [(3, 11.0, 12.0)]


def frame(spark, *rows):
    """Facts of single bars; what isn't named has nothing to say."""
    base = {"status": "HALAL", "confluence": "INSUFFICIENT_CONTEXT", "ready": False, "trend": "ranging", "event_up": None, "event_down": None, "displacement": None, "sweeps": None, "gap": None, "block": None, "pd_class": "INSUFFICIENT_CONTEXT", "ote_position": "INSUFFICIENT_CONTEXT", "range_direction": None}
    schema = ", ".join(f"{k} {'boolean' if k == 'ready' else 'array<string>' if k == 'sweeps' else 'string'}" for k in base) + ", n int"
    df = spark.createDataFrame([(*(base | r).values(), i) for i, r in enumerate(rows)], schema)
    return df.transform(signals.add_scores, Config()).transform(signals.add_votes).orderBy("n").collect()


def test_scores_and_reasons(spark):
    a, b, c, d, e = frame(spark, {}, {"confluence": "BULLISH"}, {"status": "UNKNOWN", "confluence": "BULLISH"}, {"status": "HARAM"}, {"confluence": "MIXED", "displacement": "bullish", "sweeps": ["buy_side"], "gap": "bullish", "block": "bearish", "pd_class": "DISCOUNT", "ote_position": "INSIDE_OTE", "range_direction": "bullish", "ready": True})
    assert (a.score, b.score, c.score, d.score, e.score) == (10, 25, 0, 0, 70)
    none = "missing_evidence"
    assert a.score_reasons == ["halal_status", "mtf_insufficient", none, none, none, none, none, none, none, "pd_insufficient", "ote_insufficient"]
    assert b.score_reasons[1] == "mtf_directional" and c.score_reasons == ["gated_unknown"] * 11 and d.score_reasons == ["gated_haram"] * 11
    assert e.score_reasons == ["halal_status", "mtf_mixed", none, "displacement_present", "sweep_present", "fvg_present", "order_block_present", none, none, "pd_discount", "ote_inside"]


def test_votes_and_eligibility(spark):
    a, b, c, d, e, f, g = frame(spark, {}, {"confluence": "BULLISH"}, {"status": "UNKNOWN", "confluence": "BULLISH"}, {"status": "HARAM", "confluence": "BEARISH"}, {"confluence": "BULLISH", "block": "bearish", "ready": True, "trend": "bullish"}, {"confluence": "MIXED", "event_up": "BOS"}, {"event_down": "BOS", "ote_position": "INSIDE_OTE", "range_direction": "bearish", "ready": True})
    assert {r.eligibility for r in (a, b, c, d, e, f, g)} == {"NOT_ELIGIBLE"}
    assert [r.bias for r in (a, b, c, d, e, f, g)] == ["NEUTRAL", "LONG_BIAS", "NEUTRAL", "NEUTRAL", "NEUTRAL", "NEUTRAL", "SHORT_BIAS"]
    tail = ["mss_missing", "breaker_missing", "mitigation_missing"]
    assert a.eligibility_reasons == ["threshold_not_met", "mtf_insufficient", "structure_unready", "order_block_missing", "ote_missing", *tail, "no_directional_evidence"]
    assert b.eligibility_reasons == ["threshold_not_met", "mtf_long", "structure_unready", "order_block_missing", "ote_missing", *tail]
    assert c.eligibility_reasons == ["gated_unknown"] and d.eligibility_reasons == ["gated_haram"]
    assert e.eligibility_reasons == ["threshold_not_met", "mtf_long", "structure_long", "order_block_short", "ote_missing", *tail, "conflicting_evidence"]
    assert f.eligibility_reasons[-1] == "conflicting_evidence" and "structure_event_long" in f.eligibility_reasons
    assert g.eligibility_reasons[:4] == ["threshold_not_met", "mtf_insufficient", "structure_ranging", "structure_event_short"]
    assert [v.source for v in g.votes] == ["mtf", "structure", "structure_event", "order_block", "ote", "mss", "breaker", "mitigation"]


def segment(window, name, finalized, win_rate, ret, status=None):
    return ("S", window, name, finalized, win_rate, ret, 0.1 * window, -0.1, status)


def test_stability_and_degradation(spark):
    schema = "symbol string, window_id long, segment string, finalized long, win_rate double, avg_return double, avg_mfe double, avg_mae double, status string"
    cfg = Config()

    def judged(*rows):
        return R.stability(spark.createDataFrame([segment(i, "validation", *r) for i, r in enumerate(rows)], schema), cfg, "symbol").first()

    good = (10, 0.6, 0.1, "STABLE")
    assert judged(good, good).status == "UNDERSAMPLED" and judged(good, good, good).status == "STABLE"
    assert judged(good, good, (10, 1.0, 0.3, "STABLE"), (3, 0.0, -1.0, "UNDERSAMPLED")).status == "STABLE"
    wide = judged((10, 0.5, 0.1, "STABLE"), (10, 0.5, 0.1, "STABLE"), (12, 1.0, 0.1, "STABLE"), (12, 0.4, -0.2, "WEAK"))
    assert wide.status == "WEAK" and abs(wide.win_spread - 0.6) < 1e-9 and (wide.best, wide.worst, wide.positive, wide.negative) == (0, 3, 3, 1) and abs(wide.mfe_spread - 0.3) < 1e-9 and wide.mae_spread == 0
    # every segment holds, but they lie too far apart
    far = R.stability(spark.createDataFrame([segment(i, "validation", 10, w, 0.1, "STABLE") for i, w in enumerate((0.5, 0.7, 1.0))], schema), Config(maximum_win_rate_spread=0.4), "symbol").first()
    assert far.status == "WEAK"
    rows = [segment(0, "development", 10, 0.5, 0.2), segment(0, "validation", 10, 0.7, 0.1), segment(1, "development", 10, 0.6, 0.2), segment(1, "validation", 20, 0.4, 0.3), segment(2, "development", 2, 0.0, 0.0), segment(2, "validation", 20, 1.0, 0.9)]
    out = R.degradation_summary(R.degradation(spark.createDataFrame(rows, schema), cfg, "symbol", "window_id"), "symbol").first()
    assert (out.windows, out.comparable) == (3, 2) and abs(out.mean_win_rate_change) < 1e-9 and abs(out.mean_avg_return_change) < 1e-9


def test_higher_bar_is_known_from_its_close(spark):
    low = make(spark, noise(4, 20))
    high = make(spark, noise(6, 3), 60, "1h").withColumn("trend", F.lit("bullish")).withColumn("ready", F.lit(True))
    got = {r.bar_index: r.x_bar_index for r in context.as_of(low, high, ["trend"], "x").collect()}
    assert got[3] is None and got[4] == 0 and got[7] == 0 and got[8] == 1


def test_timeframes():
    assert require_higher_multiple("15m", "4h") == 16
    for pair in (("1h", "1h"), ("4h", "6h"), ("1d", "1M")):
        with pytest.raises(ValueError):
            require_higher_multiple(*pair)


def test_outcomes_stay_open_without_a_horizon(spark):
    out = make(spark, noise(9, 30)).transform(outcomes.add_outcomes, Config(horizon=10)).orderBy("bar_index").collect()
    closes = [r[3] for r in noise(9, 30)]
    for i, r in enumerate(out):
        want = "OPEN" if i + 10 >= 30 else "WIN" if closes[i + 10] > closes[i] else "LOSS" if closes[i + 10] < closes[i] else "FLAT"
        assert r.outcome == want


def test_parse_and_clean(spark):
    rows = [("S", "2024-01-01T00:00:00Z", "1", "2", "0.5", "1.5", "3"), ("S", "1704067200000", "1", "2", "0.5", "1.5", "3"), ("S", "2024-01-01T00:15:00Z", "1", "2", "0.5", "1.5", "3"),
            ("S", "2024-01-01T00:15:00Z", "1", "2", "0.5", "1.6", "3"), ("S", "2024-01-01 00:30", "1", "2", "0.5", "1.5", "3"), ("S", "2024-01-01T00:45:00Z", "nan", "2", "0.5", "1.5", "3"), ("S", "2024-01-01T01:00:00Z", "1", "0.9", "0.5", "0.6", "3")]
    raw = spark.createDataFrame(rows, "series_key string, timestamp string, open string, high string, low string, close string, volume string")
    good, bad = candles.cleaned(candles.parsed(raw), policy="quarantine")
    assert [(r.opened_at, r.copies) for r in good.collect()] == [(START, 2)]
    assert sorted(r.reject_reason for r in bad.collect()) == ["conflict", "high too low", "missing", "timestamp"]


def test_csv_and_klines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("close,open,high,low,volume,timestamp\n1.5,1,2,0.5,3,2024-01-01T00:00:00Z\n")
    assert candles.parsed(candles.read_csv(spark, str(tmp_path / "a.csv"))).first().close == 1.5
    (tmp_path / "k.json").write_text('[[1704067200000,"1","2","0.5","1.5","3",1704068099999,"0",1,"0","0","0"],[1704068100000,"1","2","0.5","1.5","3",1704068999999,"0",1,"0","0","0"]]')
    assert candles.read_klines(spark, str(tmp_path / "k.json"), 1704068999999).count() == 1


def test_gaps_and_rollup(spark):
    bars = make(spark, noise(3, 10)).where("bar_index NOT IN (4, 5)")
    (gap,) = quality.internal_gaps(bars, 900).collect()
    assert gap.missing == 2
    parts = spark.createDataFrame([("a",), ("b",), ("c",)], "component string")
    seen = spark.createDataFrame([("a", "WARNING"), ("a", "INFO"), ("b", "INFO")], "component string, severity string")
    states = quality.rollup(parts, seen)
    assert {r.component: r.state for r in states.collect()} == {"a": "DEGRADED", "b": "HEALTHY", "c": "UNKNOWN"}
    assert quality.overall(states).first().state == "DEGRADED"


def test_candidates_declare_what_they_change():
    cfg = Config()
    assert varied(cfg, {"score_threshold": (75, 60), "atr_period": (14, 5)}) == Config(score_threshold=60, atr_period=5)
    bounds = [{"score_threshold": (75, 101)}, {"atr_period": (14, 0)}, {"min_body_atr": (1.0, 0.0)}, {"min_range_atr": (1.5, float("inf"))}, {"retracement": ((0.62, 0.79), (0.8, 0.79))}]
    for deltas in ({}, {"speed": (1, 2)}, {"atr_period": (9, 5)}, {"horizon": (10, 5)}, *bounds):
        with pytest.raises(ValueError):
            varied(cfg, deltas)


def test_shift_context_bar_by_bar(spark):
    """Every shift has its displacement, and exactly the pools, gaps and blocks that a plain search finds."""
    cfg = Config(fractal_length=3, min_range_atr=1.0, min_body_atr=0.5)
    f = P.bar_facts(make(spark, noise(21, 500)), cfg).persist()
    life = liquidity.pools(f, cfg).persist()
    f = liquidity.add_sweep_context(f, life, cfg).persist()
    got = {}
    for r in ranges.shift_context(f, life, liquidity.pool_log(f, cfg, life), cfg).collect():
        got.setdefault(r.bar_index, set()).add((r.relation, float(r.low), float(r.high), r.ref_index))
    pools_ = life.collect()
    want = {}
    rows = {r.bar_index: r for r in f.collect()}
    swept_at = {p.breach_index for p in pools_ if p.status == "swept"}
    for i, r in rows.items():
        if not r["shift"]:
            continue
        up = r["shift"] == "bullish"
        level, side = (r.prior_high, "buy_side") if up else (r.prior_low, "sell_side")
        out = {("displacement", float(r.close), float(r.close), i)}
        out |= {("pool", float(p.lower), float(p.upper), p.created_index) for p in pools_ if p.side == side and p.price == level.price and p.created_index <= level.confirm <= p.touched_index and p.breach_index == i}
        before = max((x for x in swept_at if i - cfg.sweep_lookback <= x < i), default=None)
        out |= {("swept_pool", float(p.lower), float(p.upper), before) for p in pools_ if p.status == "swept" and p.breach_index == before}
        out |= {("gap", float(r.gap_low), float(r.gap_high), i)} if r.gap == r["shift"] else set()
        out |= {("order_block", float(r.block_low), float(r.block_high), r.block_index)} if r.block == r["shift"] else set()
        want[i] = out
    assert got == want and want and any(len(x) > 1 for x in want.values())


def test_chart_draws_ranges_and_indicators(spark):
    cfg = Config(fractal_length=3)
    f = P.bar_facts(make(spark, noise(4)), cfg).persist()
    shown = R.chart(f, liquidity.pools(f, cfg), cfg, outcomes.ema_rsi(f, cfg)).persist()
    n = {(r.kind, r.name): r.n for r in shown.groupBy("kind", "name").agg(F.count("*").alias("n")).collect()}
    ranges_ = f.where("range_confirm = bar_index").count()
    assert ranges_ and n["zone", "dealing_range"] == n["level", "equilibrium"] == ranges_
    assert n["overlay", "ema_20"] == f.where("bar_index >= 19").count() and n["overlay", "atr"] == f.where("now_tr IS NOT NULL").count()
    assert shown.where("kind = 'zone' AND low > high").count() == 0


def test_window_plan(spark):
    bars = make(spark, noise(3, 130))
    cfg = Config()
    plan = R.window_plan(bars, cfg).orderBy("window_id").collect()
    assert [(r.first, r.split, r.last) for r in plan] == [(0, 50, 74), (25, 75, 99), (50, 100, 124)]
    held = R.window_bars(bars, cfg).groupBy("window_id").agg(F.count("*").alias("n"), F.min("bar_index").alias("a"), F.max("bar_index").alias("b")).collect()
    assert {(r.n, r.a, r.b) for r in held} == {(75, 0, 74)} and len(held) == 3


def test_windows_replay_the_whole_chain(spark, tmp_path):
    rng = random.Random(5)
    rows = [(6 * i + k, START + timedelta(minutes=15 * i + k), kind, 100.0 + rng.randrange(30)) for i in range(130) for k, kind in enumerate(["click", "other"])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    cfg, path = queries.CFG, str(tmp_path)
    got = {(r.symbol, r.bar_index, r.outcome) for r in queries.walked(spark, path).where("window_id = 1").collect()}
    cut = P.event_bars(spark, path, "15m").where("bar_index BETWEEN 25 AND 99").withColumn("bar_index", F.col("bar_index") - 25)
    alone = P.signal_facts(cut, {tf: P.event_bars(spark, path, tf) for tf in cfg.higher}, queries.registry(spark), cfg)
    want = {(r.symbol, r.bar_index, r.outcome) for r in alone.where("signal = 'BUY_SIGNAL'").collect()}
    assert got == want and want and {r[0] for r in got} == {"click"}


def test_stream_equals_batch(spark, tmp_path):
    cfg = Config(fractal_length=3)
    bars = make(spark, noise(12, 90)).persist()
    batch = {r.bar_index: r for r in P.structure_facts(bars, cfg).transform(outcomes.add_outcomes, cfg).collect()}
    folder = str(tmp_path / "in")
    narrow = bars.select("series_key", "opened_at", "high", "low", "close", "bar_index")
    for low, high in ((0, 20), (15, 21), (21, 60), (60, 90)):  # overlaps come twice and count once
        narrow.where(f"bar_index >= {low} AND bar_index < {high}").coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(narrow.schema).parquet(folder)
        sink = stream_facts(stream, cfg, 900).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        sink.awaitTermination(60)
    facts, ignored = split_ignored(spark.read.schema(FACTS).parquet(str(tmp_path / "out")))
    assert {(r.ignored, r.n) for r in late_counts(ignored).collect()} == {("late", 4), ("repeat", 1)}
    got = {r.bar_index: r for r in facts.collect()}
    assert sorted(got) == sorted(batch)
    for i, r in got.items():
        assert (r.trend, r.ready, r.event_up, r.event_down) == (batch[i].trend, batch[i].ready, batch[i].event_up, batch[i].event_down)
        if r.finalized_index is not None:
            assert batch[r.finalized_index].outcome == r.outcome


def test_series_state_is_bounded():
    s = Series(Config(), 900)
    for i, r in enumerate(noise(1, 500)):
        s.step(START + timedelta(minutes=15 * i), *r[1:])
    assert len(s.tail) == 5 and len(s.waiting) == 10 and all(len(v) <= 2 for v in s.swings.values())
