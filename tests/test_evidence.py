"""Evidence of higher bars, late arrivals, pools with a tolerance, digests and the order of drawing."""

from __future__ import annotations

import bisect
import collections
import hashlib
from decimal import ROUND_HALF_EVEN, Decimal

import pytest
from pyspark.sql import functions as F

from barloom.functions.core import dataset_fingerprint
from barloom.operators import context, displacement, liquidity
from barloom.plans import facts as P
from barloom.plans import reports as R
from barloom.plans.config import Config
from barloom.sources import candles
from tests.test_chunks import noise


@pytest.fixture(scope="module")
def bars(spark):
    return candles.as_series(noise(spark, 400, 3), "15m").persist()


@pytest.fixture(scope="module")
def late(spark):
    """Bars of which some arrive long after their close."""
    df = noise(spark, 500, 4)
    lag = F.pmod(F.xxhash64("opened_at", "symbol"), F.lit(9)).cast("int")
    return candles.as_series(df.withColumn("arrived_at", F.col("opened_at") + F.make_dt_interval(mins=15 + F.when(lag > 6, 400).otherwise(0))), "15m").persist()


def by_series(df):
    out = collections.defaultdict(list)
    for r in df.orderBy("series_key", "bar_index").collect():
        out[r.series_key].append(r)
    return out


def test_average_true_range_is_drawn_on_its_own_bar(bars):
    cfg = Config(atr_period=3)
    shown = R.chart(P.bar_facts(bars, cfg), liquidity.pools(P.bar_facts(bars, cfg), cfg), cfg).where("name = 'atr'")
    got = {(r.series_key, r.bar_index): r.low for r in shown.collect()}
    want = {}
    for key, rows in by_series(bars).items():
        tr = [None] + [float(max(b.high - b.low, abs(b.high - a.close), abs(b.low - a.close))) for a, b in zip(rows, rows[1:], strict=False)]
        want |= {(key, i): sum(tr[i - 2 : i + 1]) / 3 for i in range(3, len(rows))}
    assert got == pytest.approx(want)


def test_evidence_of_higher_bars(spark, bars):
    """Counts by kind up to the last higher bar that was there when a bar opened, record by record."""
    cfg = Config(fractal_length=3)
    higher = candles.as_series(noise(spark, 120, 8).withColumn("opened_at", F.to_timestamp(F.lit("2024-01-01")) + F.make_dt_interval(hours=F.floor(F.unix_seconds("opened_at") / 900 % 1000).cast("int"))).dropDuplicates(["symbol", "opened_at"]), "1h")
    facts = P.bar_facts(higher, cfg).persist()
    life = liquidity.pools(facts, cfg)
    log = liquidity.pool_log(facts, cfg, life)
    records = collections.defaultdict(list)
    when = {(r.symbol, r.bar_index): r.available_at for r in facts.collect()}
    pooled = [(r.symbol, r.bar_index) for r in log.collect()]
    swept = [(r.symbol, r.breach_index) for r in life.where("status = 'swept'").collect()]
    for kind, places in (("liquidity_pool", pooled), ("sweep", swept)):
        records[kind] += places
        records["pd_array"] += places
    for r in facts.collect():
        at = (r.symbol, r.bar_index)
        records["swing"] += [at] * ((r.swing_high is not None) + (r.swing_low is not None))
        for kind, there in (("displacement", r.displacement), ("fvg", r.gap), ("order_block", r.block)):
            if there:
                records[kind].append(at)
                records["pd_array"].append(at)
        if r.range_confirm == r.bar_index:
            for kind in ("dealing_range", "equilibrium", "ote_zone"):
                records[kind].append(at)
    times = {(k, s): sorted(when[p] for p in records[k] if p[0] == s) for k in context.PUBLISHED for s in ("aa", "bb")}
    for chunk in (None, 16):
        evidence = context.published_evidence(facts, life, log, chunk)
        out = context.htf_evidence(bars, evidence, "1h", chunk).collect()
        assert len(out) == bars.count()
        for r in out:
            for k in context.PUBLISHED:
                assert r[f"{k}_1h"] == bisect.bisect_right(times[k, r.symbol], r.opened_at), (k, r)
            assert {r[f"{k}_1h"] for k in context.STATE} == {0 if r.cursor_1h is None else 1}
    assert all(times[k, "aa"] for k in ("swing", "liquidity_pool", "displacement", "fvg", "dealing_range"))


def test_sweeps_that_are_not_there_yet_are_no_context(late):
    cfg = Config(fractal_length=3, sweep_lookback=15)
    facts = P.bar_facts(late, cfg)
    out = by_series(liquidity.add_sweep_context(facts, liquidity.pools(facts, cfg), cfg))
    passed_over = 0
    for rows in out.values():
        for i, r in enumerate(rows):
            near = [b for b in rows[max(0, i - 15) : i] if b.sweeps]
            known = [b for b in near if b.available_at <= r.opened_at]
            assert r.sweep_index == (known[-1].bar_index if known else None)
            passed_over += bool(known) and near[-1] is not known[-1]
    assert passed_over > 3


@pytest.mark.parametrize("doji", [False, True])
def test_block_candidates_were_there_when_the_displacement_opened(late, doji):
    cfg = Config(block_structure="displacement_only", allow_doji=doji, min_body_atr=0.6, min_range_atr=0.7)
    flat = late.withColumn("close", F.when(F.pmod(F.xxhash64("opened_at"), F.lit(4)) == 0, F.col("open")).otherwise(F.col("close")))
    found, passed_over, dojis = 0, 0, 0
    for rows in by_series(P.bar_facts(flat, cfg)).values():
        for i, r in enumerate(rows):
            if r.displacement is None:
                assert r.block is None
                continue
            fits = [b for b in rows[max(0, i - 10) : i] if b.high > b.low and (b.candle != r.displacement if b.candle else doji)]
            known = [b for b in fits if b.available_at <= r.opened_at]
            want = known[-1] if known and (r.close > known[-1].high if r.displacement == "bullish" else r.close < known[-1].low) else None
            assert (r.block_index, r.block_low, r.block_high) == ((want.bar_index, want.low, want.high) if want else (None,) * 3)
            found += want is not None
            passed_over += bool(fits) and (not known or known[-1] is not fits[-1])
            dojis += want is not None and want.candle is None
    assert found > 5 and passed_over > 3 and (dojis > 0) == doji


def test_ranges_and_levels_that_are_not_there_yet(late):
    cfg = Config(fractal_length=3, min_body_atr=0.6, min_range_atr=0.7)
    unknown, shifts, refused = 0, 0, 0
    for rows in by_series(P.bar_facts(late, cfg)).values():
        for before, r in zip(rows, rows[1:], strict=False):
            if r.range_confirm is not None and r.range_confirm < r.bar_index:
                known = rows[r.range_confirm].available_at <= r.opened_at and max(rows[r.last_low.confirm].available_at, rows[r.last_high.confirm].available_at) <= r.opened_at
                assert (r.ote_position != "INSUFFICIENT_CONTEXT") == known
                unknown += not known
            event = {"bullish": r.event_up, "bearish": r.event_down}.get(r.displacement)
            if event == "CHoCH" and r.prev_ready and r.prev_trend not in ("ranging", r.displacement):
                level = before.last_high if r.displacement == "bullish" else before.last_low
                known = before.available_at <= r.opened_at and rows[level.confirm].available_at <= r.opened_at
                assert (r.shift is not None) == known
                shifts, refused = shifts + known, refused + (not known)
    assert unknown > 3 and shifts > 0 and refused > 0


def test_candle_metrics(bars):
    cfg = Config(atr_period=3)
    for rows in by_series(displacement.candle_metrics(P.bar_facts(bars, cfg), cfg)).values():
        for r in rows[4:]:
            atr = float(r.prior_tr) / 3
            assert r.close_location == (None if r.high == r.low else pytest.approx(float((r.close - r.low) / (r.high - r.low))))
            assert (r.body_atr, r.span_atr) == ((None, None) if atr == 0 else pytest.approx((float(abs(r.close - r.open)) / atr, float(r.high - r.low) / atr)))


def walked(rows, bps):
    """Pools bar by bar: a swing joins the oldest active pool whose first band holds it."""
    step, unit = Decimal(bps) / 10000, Decimal("0.00000001")
    done, active = [], {"buy_side": [], "sell_side": []}
    for r in rows:
        for side, swing in (("buy_side", r.swing_high), ("sell_side", r.swing_low)):
            for p in [p for p in active[side] if (r.high > p["upper"] if side == "buy_side" else r.low < p["lower"])]:
                p["breach"] = r.bar_index
                active[side].remove(p)
            if swing is not None:
                pool = next((p for p in active[side] if p["lower"] <= swing.price <= p["upper"]), None)
                if pool is None:
                    low, high = ((swing.price + s * swing.price * step).quantize(unit, ROUND_HALF_EVEN) for s in (-1, 1))
                    pool = {"side": side, "price": swing.price, "lower": low, "upper": high, "created": r.bar_index, "breach": None, "members": 0}
                    active[side].append(pool)
                    done.append(pool)
                pool["members"] += 1
                pool["touched"], pool["known"] = r.bar_index, r.available_at
    return sorted(tuple(str(p[k]) for k in ("side", "price", "lower", "upper", "created", "touched", "breach", "members", "known")) for p in done)


@pytest.mark.parametrize("bps", [1, 37.5, 1000])
def test_pools_with_a_tolerance_by_parts(bars, bps):
    facts = P.structure_facts(bars, Config(fractal_length=3)).persist()
    got = by_series(liquidity.banded_pools(facts, Config(pool_tolerance_bps=bps)).withColumn("bar_index", F.col("created_index")))
    joined = 0
    for key, rows in by_series(facts).items():
        want = walked(rows, str(bps))
        assert sorted(tuple(str(r[k]) for k in ("side", "price", "lower", "upper", "created_index", "touched_index", "breach_index", "members", "known_at")) for r in got[key]) == want
        joined += sum(int(p[7]) > 1 for p in want)
    assert joined > 0


def test_parts_are_many_and_independent(bars):
    """Splits leave more parts than series and sides; they only say which swings can't meet."""
    facts = P.structure_facts(bars, Config(fractal_length=3))
    swings = liquidity.touches(facts).withColumns({"lower": F.col("price") * 0.995, "upper": F.col("price") * 1.005, "hit_index": F.col("confirm") + 30})
    assert liquidity.apart(swings).select("series_key", "side", "part").distinct().count() > 20


def test_fingerprint_is_a_sum_of_digests(spark):
    rows = [("a", 1, "x"), ("a", 2, None), ("a", 2, None), ("b", None, "x")] + [("c", i, f"v{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "series_key string, n int, t string")

    def digest(n, t):
        text = '{"n":%s,"t":%s}' % ("null" if n is None else n, "null" if t is None else f'"{t}"')
        return int(hashlib.sha256(text.encode()).hexdigest(), 16)

    want = collections.defaultdict(int)
    for k, n, t in rows:
        want[k] += digest(n, t)
    got = {r.series_key: (r.n, r.fingerprint) for r in dataset_fingerprint(df).collect()}
    assert got == {k: (sum(r[0] == k for r in rows), f"{v % (1 << 256):064x}") for k, v in want.items()}
    assert got == {r.series_key: (r.n, r.fingerprint) for r in dataset_fingerprint(df.repartition(7, "t")).collect()}
    once = {r.series_key: r.fingerprint for r in dataset_fingerprint(df.distinct()).collect()}
    assert once["a"] != got["a"][1] and once["b"] == got["b"][1]


def test_order_of_drawing(bars):
    cfg = Config(fractal_length=3)
    facts = P.bar_facts(bars.where("bar_index < 120"), cfg).persist()
    shown = R.drawing_order(R.chart(facts, liquidity.pools(facts, cfg), cfg).repartition(5, "low")).collect()
    rank = {k: i for i, k in enumerate(("level", "zone", "marker", "text", "overlay"))}
    keys = {"level": lambda r: (r.low, r.name), "zone": lambda r: (r.bar_index, r.low, r.name), "marker": lambda r: (r.bar_index, r.low, r.name), "overlay": lambda r: (r.bar_index, r.name, r.low)}
    order = [(r.series_key, rank[r.kind], keys[r.kind](r)) for r in shown]
    assert order == sorted(order) and len({r.kind for r in shown}) == 4
    zones = [r for r in shown if r.name == "dealing_range"]
    assert zones and all(r.bar_index <= r.end_index for r in zones)
