"""SQL that gives the same rows as the engine's queries, for checks by another engine."""

from __future__ import annotations

PART = "over (partition by symbol order by i"
BEFORE = f"{PART} rows between unbounded preceding and 1 preceding)"
NOW_ON = f"{PART} rows between unbounded preceding and current row)"


def bars(interval: str, p: str = "", source: str = "") -> str:
    """Candles of a table; p: prefix of the names."""
    source = source or "select event_type as symbol, ts, event_id as tie, value::decimal(18,8) as px from events"
    return f"""
{p}b as (select symbol, time_bucket(interval '{interval}', ts) as opened_at, arg_min(px, struct_pack(t := ts, e := tie)) as open, max(px) as high, min(px) as low,
  arg_max(px, struct_pack(t := ts, e := tie)) as close, count(*) as volume from ({source}) where px > 0 group by 1, 2),
{p}f as (select *, opened_at + interval '{interval}' as closed_at, row_number() over (partition by symbol order by opened_at) - 1 as i from {p}b)"""


def structure(p: str = "", part: str = "symbol") -> str:
    w = f"over (partition by {part} order by i"
    before, now_on = f"{w} rows between unbounded preceding and 1 preceding)", f"{w} rows between unbounded preceding and current row)"
    return f""",
{p}s as (select *, lag(close) {w}) as pc,
  case when i >= 4 and lag(high, 2) {w}) > greatest(lag(high, 4) {w}), lag(high, 3) {w}), lag(high, 1) {w}), high) then lag(high, 2) {w}) end as sh,
  case when i >= 4 and lag(low, 2) {w}) < least(lag(low, 4) {w}), lag(low, 3) {w}), lag(low, 1) {w}), low) then lag(low, 2) {w}) end as sl from {p}f),
{p}t1 as (select *, last_value(sh ignore nulls) {before} as ph, last_value(case when sh is not null then i end ignore nulls) {before} as phc,
  last_value(sl ignore nulls) {before} as pl, last_value(case when sl is not null then i end ignore nulls) {before} as plc,
  last_value(sh ignore nulls) {now_on} as lh, last_value(case when sh is not null then i end ignore nulls) {now_on} as lhc,
  last_value(sl ignore nulls) {now_on} as ll, last_value(case when sl is not null then i end ignore nulls) {now_on} as llc from {p}s),
{p}t2 as (select *, last_value(case when sh is not null then ph end ignore nulls) {now_on} as hb, last_value(case when sl is not null then pl end ignore nulls) {now_on} as lb from {p}t1),
{p}t3 as (select *, hb is not null and lb is not null as ready,
  case when hb is null or lb is null then 'ranging' when lh > hb and ll > lb then 'bullish' when lh < hb and ll < lb then 'bearish' else 'ranging' end as trend,
  coalesce(pc <= ph and ph < close, false) as ux, coalesce(pc >= pl and pl > close, false) as dx from {p}t2),
{p}t4 as (select *, coalesce(lag(trend) {w}), 'ranging') as pt, coalesce(lag(ready) {w}), false) as pready, lag(lh) {w}) as plh, lag(ll) {w}) as pll,
  sum(ux::int) over (partition by {part}, phc order by i rows between unbounded preceding and 1 preceding) as uu,
  sum(dx::int) over (partition by {part}, plc order by i rows between unbounded preceding and 1 preceding) as du from {p}t3),
{p}st as (select *, case when ux and coalesce(uu, 0) = 0 then case pt when 'bullish' then 'BOS' when 'bearish' then 'CHoCH' end end as eu,
  case when dx and coalesce(du, 0) = 0 then case pt when 'bearish' then 'BOS' when 'bullish' then 'CHoCH' end end as ed from {p}t4)"""


FACTS = f""",
d1 as (select *, case when pc is not null then greatest(high - low, abs(high - pc), abs(low - pc)) end as tr, abs(close - open) as body, high - low as span,
  case when close > open then 'bullish' when close < open then 'bearish' end as candle from st),
d2 as (select *, case when count(tr) {PART} rows between 14 preceding and 1 preceding) = 14 then sum(tr) {PART} rows between 14 preceding and 1 preceding) end as ptr,
  case when count(tr) {PART} rows between 13 preceding and current row) = 14 then sum(tr) {PART} rows between 13 preceding and current row) end as ntr,
  lag(high, 2) {PART}) as h1, lag(low, 2) {PART}) as l1 from d1),
d3 as (select *, case when candle is not null and span > 0 and ptr > 0 and body * 14 >= ptr and span * 14 >= 1.5 * ptr
  and case when candle = 'bullish' then close - low >= 0.70 * span else close - low <= 0.30 * span end then candle end as disp from d2),
d4 as (select *, case when low > h1 then 'bullish' when high < l1 then 'bearish' end as gap, lag(disp) {PART}) as mid,
  last_value(case when candle = 'bullish' and high > low then i end ignore nulls) {PART} rows between 10 preceding and 1 preceding) as cbi,
  last_value(case when candle = 'bullish' and high > low then high end ignore nulls) {PART} rows between 10 preceding and 1 preceding) as cbh,
  last_value(case when candle = 'bullish' and high > low then low end ignore nulls) {PART} rows between 10 preceding and 1 preceding) as cbl,
  last_value(case when candle = 'bearish' and high > low then i end ignore nulls) {PART} rows between 10 preceding and 1 preceding) as csi,
  last_value(case when candle = 'bearish' and high > low then high end ignore nulls) {PART} rows between 10 preceding and 1 preceding) as csh,
  last_value(case when candle = 'bearish' and high > low then low end ignore nulls) {PART} rows between 10 preceding and 1 preceding) as csl from d3),
d5 as (select *, case when disp = 'bullish' and eu is not null and close > csh then 'bullish' when disp = 'bearish' and ed is not null and close < cbl then 'bearish' end as blk,
  case when gap = 'bullish' then h1 when gap = 'bearish' then high end as glo, case when gap = 'bullish' then low when gap = 'bearish' then l1 end as ghi, coalesce(mid = gap, false) as gdisp from d4),
d6 as (select *, case when blk = 'bullish' then csl when blk = 'bearish' then cbl end as blo, case when blk = 'bullish' then csh when blk = 'bearish' then cbh end as bhi,
  case when blk = 'bullish' then csi when blk = 'bearish' then cbi end as bi,
  case when ll is null or lh is null then 'missing_swings' when llc = lhc then 'same_pivot' when lh <= ll then 'nonpositive_span' else 'confirmed' end as rst from d5),
d7 as (select *, case when rst = 'confirmed' then ll end as rlo, case when rst = 'confirmed' then lh end as rhi, case when rst = 'confirmed' then case when llc < lhc then 'bullish' else 'bearish' end end as rdir,
  case when rst = 'confirmed' then greatest(llc, lhc) end as rcf from d6),
d8 as (select *, case when rlo is null then 'INSUFFICIENT_CONTEXT' when close < rlo or close > rhi then 'OUTSIDE_RANGE' when close = rlo + (rhi - rlo) * 0.5 then 'EQUILIBRIUM'
  when close < rlo + (rhi - rlo) * 0.5 then 'DISCOUNT' else 'PREMIUM' end as pd,
  case when rdir = 'bullish' then rhi - (rhi - rlo) * 0.79 when rdir = 'bearish' then rlo + (rhi - rlo) * 0.62 end as olo,
  case when rdir = 'bullish' then rhi - (rhi - rlo) * 0.62 when rdir = 'bearish' then rlo + (rhi - rlo) * 0.79 end as ohi from d7),
facts as (select *, case when rcf is null or rcf >= i then 'INSUFFICIENT_CONTEXT' when close < olo then 'BELOW_OTE' when close > ohi then 'ABOVE_OTE' else 'INSIDE_OTE' end as opos,
  case when pready and pt <> 'ranging' and disp <> pt and ((disp = 'bullish' and eu = 'CHoCH' and plh is not null) or (disp = 'bearish' and ed = 'CHoCH' and pll is not null)) then disp end as shift from d8)"""

TOUCHES = """,
touches as (select symbol, 'buy_side' as side, sh as price, i as confirm, closed_at as known from st where sh is not null
  union all select symbol, 'sell_side', sl, i, closed_at from st where sl is not null)"""
POOLS = TOUCHES + """,
hit as (select t.symbol, t.side, t.confirm, min(b.i) as breach from touches t join f b on b.symbol = t.symbol and b.i > t.confirm and ((t.side = 'buy_side' and b.high > t.price) or (t.side = 'sell_side' and b.low < t.price)) group by 1, 2, 3),
grouped as (select t.symbol, t.side, t.price, h.breach, min(t.confirm) as created, max(t.confirm) as touched, count(*) as members, max(t.known) as known
  from touches t left join hit h on h.symbol = t.symbol and h.side = t.side and h.confirm = t.confirm group by 1, 2, 3, 4),
judged as (select g.*, s.high as bh, s.low as bl, case when g.breach is null then null when g.known > s.opened_at then 'not_known_at_open'
  when (side = 'buy_side' and greatest(s.pc, s.open) > price) or (side = 'sell_side' and least(s.pc, s.open) < price) then 'started_outside'
  when (side = 'buy_side' and s.close >= price) or (side = 'sell_side' and s.close <= price) then 'not_reclaimed' end as reason
  from grouped g left join s on s.symbol = g.symbol and s.i = g.breach),
pools as (select *, case when breach is null then 'active' when reason is null then 'swept' else 'invalidated' end as status,
  case when members > 1 then case side when 'buy_side' then 'equal_highs' else 'equal_lows' end else case side when 'buy_side' then 'swing_high' else 'swing_low' end end as kind from judged)"""
SWEPT = """,
swept as (select symbol, breach as i, bool_or(side = 'buy_side') as b, bool_or(side = 'sell_side') as l from pools where status = 'swept' group by 1, 2)"""
BROKEN = """,
blocks as (select symbol, i as pub, closed_at as bknown, blk, blo, bhi from facts where blk is not null),
through as (select b.symbol, b.pub, min(x.i) as h from blocks b join facts x on x.symbol = b.symbol and x.i > b.pub and ((b.blk = 'bullish' and x.close < b.blo) or (b.blk = 'bearish' and x.close > b.bhi)) group by 1, 2),
broken as (select b.*, t.h, case when b.bknown > x.opened_at then 'SOURCE_NOT_KNOWN_AT_OPEN' when (b.blk = 'bullish' and x.pc < b.blo) or (b.blk = 'bearish' and x.pc > b.bhi) then 'PREVIOUS_CLOSE_ALREADY_BEYOND'
  when x.disp is null then 'MISSING_DISPLACEMENT' when x.disp = b.blk then 'WRONG_DISPLACEMENT_DIRECTION' when x.shift is null then 'MISSING_MSS' when x.shift = b.blk then 'WRONG_MSS_DIRECTION' else '-' end as rejection
  from blocks b join through t on t.symbol = b.symbol and t.pub = b.pub join facts x on x.symbol = b.symbol and x.i = t.h)"""


def higher(tf: str) -> str:
    interval = {"1h": "1 hour", "4h": "4 hours"}[tf]
    n = f"h{tf[0]}"
    return f""",{bars(interval, n)}{structure(n)},
{n}j as (select f.symbol, f.i, max(x.i) as cur from f left join {n}st x on x.symbol = f.symbol and x.closed_at <= f.opened_at group by 1, 2),
{n}d as (select j.symbol, j.i, j.cur, case when j.cur is null or not x.ready then 'INSUFFICIENT_CONTEXT' when x.trend = 'ranging' then 'NEUTRAL' else upper(x.trend) end as dir
  from {n}j j left join {n}st x on x.symbol = j.symbol and x.i = j.cur)"""


CONFLUENCE = higher("1h") + higher("4h") + """,
conf as (select a.symbol, a.i, a.dir as d1, b.dir as d4, a.cur as c1, b.cur as c4, case when a.dir = 'INSUFFICIENT_CONTEXT' then b.dir when b.dir = 'INSUFFICIENT_CONTEXT' or a.dir = b.dir then a.dir else 'MIXED' end as confluence
  from h1d a join h4d b on b.symbol = a.symbol and b.i = a.i)"""
OUTCOMES = f""",
o1 as (select symbol, i, opened_at, close, lead(close, 10) {PART}) as fc, max(high) {PART} rows between 1 following and 10 following) as mx, min(low) {PART} rows between 1 following and 10 following) as mn from f),
o2 as (select o.*, case when fc is null then 'OPEN' when fc > close then 'WIN' when fc < close then 'LOSS' else 'FLAT' end as outcome, (fc::double - close::double) / close::double as fr,
  (select min(x.i) from f x where x.symbol = o.symbol and x.i between o.i + 1 and o.i + 10 and x.high = o.mx) as mxi, (select min(x.i) from f x where x.symbol = o.symbol and x.i between o.i + 1 and o.i + 10 and x.low = o.mn) as mni from o1 o)"""
REGIME = f""",
r1 as (select symbol, i, close, abs(close::double - lag(close::double) {PART})) as mv, abs(close::double - lag(close::double, 20) {PART})) as net from f),
r2 as (select *, sum(mv) {PART} rows between 19 preceding and current row) as path, avg(mv) {PART} rows between 19 preceding and current row) as a1, avg(mv) {PART} rows between 79 preceding and current row) as a4 from r1),
reg as (select symbol, i, case when i >= 20 then case when path > 0 then net / path else 0 end end as er, case when i >= 80 and a4 <> 0 then a1 / a4 end as vr from r2),
regime as (select *, case when vr is null then null when er >= 0.30 then 'TRENDING' when vr >= 1.5 then 'HIGH_VOLATILITY' when vr <= 0.75 then 'LOW_VOLATILITY' else 'RANGING' end as regime from reg)"""
SCORED = POOLS + SWEPT + CONFLUENCE + f""",
z1 as (select x.*, c.confluence, c.c1, c.c4, w.symbol is not null as swept, case when x.symbol in ('click', 'view', 'purchase') then 'HALAL' else 'UNKNOWN' end as status,
  last_value(case when w.symbol is not null then x.i end ignore nulls) over (partition by x.symbol order by x.i rows between unbounded preceding and 1 preceding) as si
  from facts x join conf c on c.symbol = x.symbol and c.i = x.i left join swept w on w.symbol = x.symbol and w.i = x.i),
z2 as (select *, si is not null and i - si <= 20 as after_sweep, case when status <> 'HALAL' then 0 else 10 + case confluence when 'BULLISH' then 15 when 'BEARISH' then 15 when 'NEUTRAL' then 8 when 'MIXED' then 5 else 0 end
  + case when disp is not null then 12 else 0 end + case when swept then 10 else 0 end + case when gap is not null then 8 else 0 end + case when blk is not null then 10 else 0 end
  + case pd when 'DISCOUNT' then 8 when 'EQUILIBRIUM' then 5 when 'PREMIUM' then 3 when 'OUTSIDE_RANGE' then 1 else 0 end + case opos when 'INSIDE_OTE' then 7 when 'INSUFFICIENT_CONTEXT' then 0 else 3 end end as score from z1),
z3 as (select *, status = 'HALAL' and score >= 30 as passed,
  (confluence = 'BULLISH')::int + (trend = 'bullish')::int + (eu is not null)::int + coalesce((blk = 'bullish')::int, 0) + (opos = 'INSIDE_OTE' and rdir = 'bullish')::int as longs,
  (confluence = 'BEARISH')::int + (trend = 'bearish')::int + (ed is not null)::int + coalesce((blk = 'bearish')::int, 0) + (opos = 'INSIDE_OTE' and rdir = 'bearish')::int as shorts from z2),
z4 as (select *, case when status <> 'HALAL' or confluence = 'MIXED' or (longs > 0 and shorts > 0) then 'NEUTRAL' when longs > 0 then 'LONG_BIAS' when shorts > 0 then 'SHORT_BIAS' else 'NEUTRAL' end as bias from z3),
z5 as (select *, case when not passed then 'NO_SIGNAL' when bias = 'SHORT_BIAS' then 'BEARISH_AVOID' when bias = 'LONG_BIAS' then 'BUY_SIGNAL' else 'NO_SIGNAL' end as cand from z4),
z6 as (select *, cand = 'BUY_SIGNAL' and row_number() over (partition by symbol, cand, bias, c1, c4, case when olo is not null then rlo end, case when olo is not null then rhi end, case when olo is not null then rcf end,
  case when blk is not null then i end, case when gap is not null then i end, case when disp is not null then i end order by i) > 1 as again from z5),
sig as (select *, case when again then 'NO_SIGNAL' else cand end as signal,
  concat_ws('+', case when disp = 'bullish' then 'bullish_displacement' end, case when disp is not null and after_sweep then 'sweep_associated' end, case when gap = 'bullish' then 'fvg_bullish' end, case when gap = 'bearish' then 'fvg_bearish' end,
  case when blk = 'bullish' then 'order_block_bullish' end, case when blk = 'bearish' then 'order_block_bearish' end, case when opos = 'INSIDE_OTE' then 'inside_ote' end, case when pd = 'DISCOUNT' then 'pd_discount' end,
  case when pd = 'PREMIUM' then 'pd_premium' end, case when pd = 'EQUILIBRIUM' then 'pd_equilibrium' end, case when confluence = 'BULLISH' then 'mtf_bullish' end, case when confluence = 'MIXED' then 'mtf_mixed' end) as labels from z6)"""
PUBLISHED = SCORED + OUTCOMES + REGIME + """,
pub as (select g.symbol, g.symbol || ':15m:local:events:default' as series_key, '15m' as timeframe, g.i, strftime(g.opened_at, '%Y-%m') as month, g.score, g.labels, case when g.labels = '' then 'no_labels' else g.labels end as combination,
  r.regime, o.outcome, o.fr from sig g join o2 o on o.symbol = g.symbol and o.i = g.i join regime r on r.symbol = g.symbol and r.i = g.i where g.signal = 'BUY_SIGNAL')"""


def r6(x: str, name: str = "") -> str:
    return f"round(({x})::double, 6) as {name or x}"


STATS = """count(*) as total, count(*) filter (where outcome = 'OPEN') as open, count(*) filter (where outcome = 'WIN') as win, count(*) filter (where outcome = 'LOSS') as loss, count(*) filter (where outcome = 'FLAT') as flat,
 count(*) filter (where outcome <> 'OPEN') as finalized, round(count(*) filter (where outcome = 'WIN')::double / nullif(count(*) filter (where outcome <> 'OPEN'), 0), 6) as win_rate"""
RETURN = "round(avg(fr) filter (where outcome <> 'OPEN'), 5) as avg_return"
B15, B1H, B4H = bars("15 minutes"), bars("1 hour"), bars("4 hours")
ST = B15 + structure()
ALL = ST + FACTS
SUFFICIENT = "count(*) filter (where outcome <> 'OPEN') >= 10 as sufficient"


def q(chain: str, select: str) -> str:
    return f"with {chain.lstrip(',')}\n{select}"


def dimensions(columns: dict[str, str], source: str, more: str) -> str:
    parts = [f"select 'overall' as dimension, 'all' as \"group\", {more} from {source}"]
    parts += [f"select '{k}', coalesce({v}, 'unclassified'), {more} from {source} group by {v}" for k, v in columns.items()]
    return "\nunion all ".join(parts)


def variant(threshold: int) -> str:
    """Win rates of the chain's signals at a score threshold."""
    chain = ALL + PUBLISHED.replace("score >= 30", f"score >= {threshold}")
    n, won = "count(*) filter (where outcome <> 'OPEN')", "count(*) filter (where outcome = 'WIN')"
    return q(chain, dimensions({"symbol": "symbol", "month": "month", "combination": "combination"}, "pub", f"{n} as n, {won}::double / nullif({n}, 0) as wr"))


BAR = f"symbol, i as bar_index, epoch(opened_at)::bigint as opened_at, {r6('open')}, {r6('high')}, {r6('low')}, {r6('close')}, {r6('volume')}"
RAW = "select event_type as series_key, date_trunc('hour', ts) as hr, value from events"
KEY = "symbol || ':15m:local:events:default' as series_key"
GAPS = "select symbol, opened_at, lag(opened_at) over (partition by symbol order by i) as prev from f"
CELL = "case when count(*) filter (where outcome <> 'OPEN') < 20 then 'UNDERSAMPLED' when count(*) filter (where outcome = 'WIN')::double / nullif(count(*) filter (where outcome <> 'OPEN'), 0) >= 0.6 and avg(fr) filter (where outcome <> 'OPEN') > 0 then 'WINNER' when count(*) filter (where outcome = 'WIN')::double / nullif(count(*) filter (where outcome <> 'OPEN'), 0) <= 0.4 and avg(fr) filter (where outcome <> 'OPEN') < 0 then 'LOSER' else 'NEUTRAL' end as pattern"
CELLS = {"setup": "combination", "symbol": "symbol", "timeframe": "timeframe", "month": "month", "regime": "regime"}


def zone_class(x: str) -> str:
    return f"case when rlo is null then 'INSUFFICIENT_CONTEXT' when {x} < rlo or {x} > rhi then 'OUTSIDE_RANGE' when {x} = rlo + (rhi - rlo) * 0.5 then 'EQUILIBRIUM' when {x} < rlo + (rhi - rlo) * 0.5 then 'DISCOUNT' else 'PREMIUM' end"


WINDOWS = B15.replace("f as (", "f0 as (", 1) + """,
plan as (select symbol, unnest(generate_series(0, (n - 75) // 25)) as window_id from (select symbol, count(*) as n from f0 group by 1) where n >= 75),
f as (select x.symbol || '#' || p.window_id as symbol, x.symbol as parent, p.window_id, x.* exclude (i, symbol), x.i - p.window_id * 25 as i from plan p join f0 x on x.symbol = p.symbol and x.i between p.window_id * 25 and p.window_id * 25 + 74)"""
# every window is a symbol of its own; higher bars, the listing and regimes are those of its parent
WINDOWED = (structure() + FACTS + SCORED).replace("x.symbol = f.symbol and x.closed_at", "x.symbol = f.parent and x.closed_at").replace("on x.symbol = j.symbol and x.i = j.cur", "on x.symbol = split_part(j.symbol, '#', 1) and x.i = j.cur").replace("case when x.symbol in ('click'", "case when x.parent in ('click'")
WALKED = WINDOWS + WINDOWED + REGIME.replace(" as net from f)", " as net from f0)") + f""",
ow as (select symbol, i, close::double as c, lead(close, 10) {PART})::double as fc, max(high) {PART} rows between 1 following and 10 following)::double as mx, min(low) {PART} rows between 1 following and 10 following)::double as mn from f),
wk as (select g.parent as symbol, g.window_id, g.i, '15m' as timeframe, strftime(g.opened_at, '%Y-%m') as month, case when g.labels = '' then 'no_labels' else g.labels end as combination, r.regime, case when g.i < 50 then 'development' else 'validation' end as segment,
  case when fc is null then 'OPEN' when fc > c then 'WIN' when fc < c then 'LOSS' else 'FLAT' end as outcome, (fc - c) / c as fr, (mx - c) / c as mfe, (mn - c) / c as mae
  from sig g join ow on ow.symbol = g.symbol and ow.i = g.i join regime r on r.symbol = g.parent and r.i = g.i + g.window_id * 25 where g.signal = 'BUY_SIGNAL'),
val as (select * from wk where segment = 'validation')"""
DONE = "filter (where outcome <> 'OPEN')"
SEGMENTS = WALKED + f""",
sg as (select symbol, window_id, segment, {STATS}, avg(fr) {DONE} as ar, avg(mfe) {DONE} as amfe, avg(mae) {DONE} as amae, count(*) filter (where outcome = 'WIN')::double / nullif(count(*) {DONE}, 0) as wr from wk group by 1, 2, 3),
seg as (select p.symbol, p.window_id, k.segment, {", ".join(f"coalesce({c}, 0) as {c}" for c in ("total", "open", "win", "loss", "flat", "finalized"))}, win_rate, ar, amfe, amae, wr
  from plan p cross join (values ('development'), ('validation')) k(segment) left join sg on sg.symbol = p.symbol and sg.window_id = p.window_id and sg.segment = k.segment)"""
CHANGES = SEGMENTS + """,
ch as (select symbol, window_id, max(wr) filter (where segment = 'validation') - max(wr) filter (where segment = 'development') as dw, max(ar) filter (where segment = 'validation') - max(ar) filter (where segment = 'development') as da,
  coalesce(max(finalized) filter (where segment = 'validation') >= 10 and max(finalized) filter (where segment = 'development') >= 10, false) as sure from seg group by 1, 2)"""
ORDERS = bars("1 day", source="select o_orderpriority as symbol, o_orderdate as ts, o_orderkey as tie, o_totalprice::decimal(18,8) as px from orders")
PRIMITIVES = """,
prim as (select symbol, 'level' as kind, case side when 'buy_side' then 'swing_high' else 'swing_low' end as name, created as i, price::double as low, price::double as high, null::bigint as e from pools
  union all select symbol, 'zone', 'gap_' || gap, i, glo::double, ghi::double, null from facts where gap is not null
  union all select symbol, 'zone', 'block_' || blk, bi, blo::double, bhi::double, null from facts where blk is not null
  union all select symbol, 'marker', 'sweep_' || side, breach, case side when 'buy_side' then bh else bl end::double, case side when 'buy_side' then bh else bl end::double, null from pools where status = 'swept'
  union all select symbol, 'marker', 'displacement_' || disp, i, close::double, close::double, null from facts where disp is not null
  union all select symbol, 'zone', 'dealing_range', least(llc, lhc) - 2, rlo::double, rhi::double, greatest(llc, lhc) - 2 from facts where rcf = i
  union all select symbol, 'level', 'equilibrium', i, (rlo + rhi)::double / 2, (rlo + rhi)::double / 2, null from facts where rcf = i
  union all select symbol, 'zone', 'retracement_' || rdir, i, olo::double, ohi::double, null from facts where rcf = i
  union all select symbol, 'overlay', 'atr', i, ntr::double / 14, ntr::double / 14, null from facts where ntr is not null)"""
BOUGHT = """,
drawn as (select * from prim union all select symbol, 'marker', 'buy_signal', i, close::double, close::double, null from sig where signal = 'BUY_SIGNAL'
  union all select symbol, 'text', 'score ' || score, i, close::double, close::double, null from sig where signal = 'BUY_SIGNAL'
  union all select g.symbol, 'marker', 'outcome_' || lower(o.outcome), g.i + 10, o.fc::double, o.fc::double, null from sig g join o2 o on o.symbol = g.symbol and o.i = g.i where g.signal = 'BUY_SIGNAL' and o.outcome <> 'OPEN'
  union all select symbol, 'overlay', 'ema_20', i, e20, e20, null from r where e20 is not null union all select symbol, 'overlay', 'ema_50', i, e50, e50, null from r where e50 is not null)"""
VERSIONS = """select t.symbol, t.side, t.price, p.created, t.confirm as i, 'active' as status from touches t join pools p on p.symbol = t.symbol and p.side = t.side and p.price = t.price and t.confirm between p.created and p.touched
 union all select symbol, side, price, created, breach, status from pools where status <> 'active'"""
EXTREME = "case side when 'buy_side' then bh else bl end"

EMA = f""", z as (select symbol, i, close::double as c, close::double - lag(close::double) {PART}) as ch from f),
 sd as (select symbol, avg(c) filter (where i < 20) as a20, avg(c) filter (where i < 50) as a50, sum(greatest(ch, 0)) filter (where i between 1 and 14) / 14 as g, sum(greatest(-ch, 0)) filter (where i between 1 and 14) / 14 as l from z group by 1),
 r as (select z.symbol, z.i, null::double as e20, null::double as e50, null::double as g, null::double as l from z where i = 0
  union all select z.symbol, z.i, case when z.i = 19 then sd.a20 when z.i > 19 then r.e20 + (z.c - r.e20) * 2 / 21 end, case when z.i = 49 then sd.a50 when z.i > 49 then r.e50 + (z.c - r.e50) * 2 / 51 end,
  case when z.i = 14 then sd.g when z.i > 14 then (r.g * 13 + greatest(z.ch, 0)) / 14 end, case when z.i = 14 then sd.l when z.i > 14 then (r.l * 13 + greatest(-z.ch, 0)) / 14 end
  from r join z on z.symbol = r.symbol and z.i = r.i + 1 join sd on sd.symbol = r.symbol)"""


def recursive(sql: str) -> str:
    return "with recursive" + sql.removeprefix("with")


#: What each bar of the first chain publishes, by kind, and its running sums.
EVIDENCE = """,
version as (select symbol, i, count(*) as n from (""" + VERSIONS + """) group by 1, 2),
sweep as (select symbol, breach as i, count(*) as n from pools where status = 'swept' group by 1, 2),
new as (select c.symbol, c.i, c.closed_at, (c.sh is not null)::int + (c.sl is not null)::int as swing, coalesce(v.n, 0) as liquidity_pool, coalesce(w.n, 0) as sweep, (c.disp is not null)::int as displacement,
  (c.gap is not null)::int as fvg, (c.blk is not null)::int as order_block, coalesce(c.rcf = c.i, false)::int as dealing_range
  from facts c left join version v on v.symbol = c.symbol and v.i = c.i left join sweep w on w.symbol = c.symbol and w.i = c.i),
total as (select symbol, i, closed_at, """ + ", ".join(f"sum({c}) {NOW_ON} as {n}" for c, n in [*((c, c) for c in ("swing", "liquidity_pool", "sweep", "displacement", "fvg", "order_block", "dealing_range")), ("liquidity_pool + sweep + displacement + fvg + order_block", "pd_array"), ("dealing_range", "equilibrium"), ("dealing_range", "ote_zone")]) + """ from new)"""
KINDS = ("swing", "liquidity_pool", "sweep", "displacement", "fvg", "order_block", "pd_array", "dealing_range", "equilibrium", "ote_zone")
LATEST = ("structure_context", "pd_snapshot", "ote_observation", "ote_snapshot")

ORACLES = {
    "bars_15m": q(B15, f"select {BAR} from f"),
    "bars_1h": q(B1H, f"select {BAR} from f"),
    "bars_orders": q(ORDERS, f"select {BAR} from f"),
    "candle_audit": f"""with r as ({RAW}), t as (select series_key, count(distinct hr) as n from r where value > 0 group by 1)
select r.series_key, count(*) as input_rows, 0::bigint as missing_dropped, count(*) filter (where not value > 0) as rejected, least(any_value(t.n), 100)::bigint as output_rows,
 count(*) filter (where value > 0) - any_value(t.n) as duplicates_removed, (any_value(t.n) - least(any_value(t.n), 100))::bigint as trimmed from r left join t on t.series_key = r.series_key group by 1""",
    "candle_conflicts": f"""with r as ({RAW})
select series_key, epoch(hr)::bigint as opened_at, case when min(value) = max(value) then 'kept' else 'conflict' end as state from r where value > 0 group by 1, 2
union all select series_key, epoch(hr)::bigint, 'price not above zero' from r where not value > 0""",
    "latest_n_bars": q(B15, f"select symbol, i as bar_index, {r6('close')} from (select *, row_number() over (partition by symbol order by i desc) as k from f) where k <= 5"),
    "gaps": q(B15, f"""select {KEY}, epoch(prev)::bigint + 900 as expected_at, epoch(opened_at)::bigint as actual_at, ceil((epoch(opened_at) - epoch(prev) - 900) / 900.0)::bigint as missing
from ({GAPS}) where epoch(opened_at) - epoch(prev) > 900"""),
    "intervals": q(B15, f"""select symbol, case when o < 0 then 'overlap' when o % 900 <> 0 then 'anomaly' when o // 900 > 0 then 'gap' else 'none' end as condition, count(*) as n, sum(o // 900)::bigint as intervals
from (select symbol, epoch(opened_at)::bigint - epoch(prev)::bigint - 900 as o from ({GAPS}) where prev is not null) group by 1, 2"""),
    "freshness": q(B1H, """select symbol || ':1h:local:events:default' as series_key, round(a::double, 6) as age_seconds, case when a < 0 then 'future' when a > 10800 then 'stale' else 'fresh' end as state
from (select symbol, epoch(timestamp '2024-02-01') - epoch(max(closed_at)) as a from f group by 1)"""),
    "condition_rollup": q(B15, f"""select code, severity, count(*) as n, count(*) as distinct_events from (
 select 'data_gap' as code, 'WARNING' as severity from ({GAPS}) where epoch(opened_at) - epoch(prev) > 900
 union all select case when a < 0 then 'data_future_timestamp' else 'data_stale' end, case when a < 0 then 'CRITICAL' else 'WARNING' end from (select epoch(timestamp '2024-02-01') - epoch(max(closed_at)) as a from f group by symbol) where a < 0 or a > 2700
 union all select 'data_malformed', 'WARNING' from events group by event_type having count(*) filter (where not value > 0) > 0
 union all select 'data_duplicates_removed', 'INFO' from events group by event_type having count(*) filter (where value > 0) > count(distinct date_trunc('hour', ts)) filter (where value > 0)
 union all select 'data_rows_trimmed', 'INFO' from events group by event_type having count(distinct date_trunc('hour', ts)) filter (where value > 0) > 100) group by 1, 2"""),
    "swings": q(ST + TOUCHES, f"select symbol, side, {r6('price')}, confirm from touches"),
    "trend": q(ST, "select symbol, i as bar_index, trend, ready from st"),
    "structure_events": q(ST, """select symbol, strftime(opened_at, '%Y-%m') as month, event, direction, count(*) as n from (
 select symbol, opened_at, eu as event, 'bullish' as direction from st where eu is not null union all select symbol, opened_at, ed, 'bearish' from st where ed is not null) group by 1, 2, 3, 4"""),
    "structure_rows": q(ST, f"""select symbol, i as bar_index, 'bullish' as direction, eu as event, {r6('ph', 'level')} from st where eu is not null
union all select symbol, i, 'bearish', ed, {r6('pl', 'level')} from st where ed is not null"""),
    "pools": q(ST + POOLS, f"select symbol, side, {r6('price')}, created as created_index, touched as touched_index, members, kind, coalesce(breach, -1)::bigint as breach_index, status, coalesce(reason, '-') as reason from pools"),
    "sweeps": q(ST + POOLS, f"select symbol, side, breach as breach_index, {r6('price')}, {r6(EXTREME, 'extreme')} from pools where status = 'swept'"),
    "active_pools": q(ST + POOLS, "select symbol, side, count(*) as n, round(max(price)::double, 6) as top from pools where breach is null group by 1, 2"),
    "banded_pools": recursive(q(ST + TOUCHES, """, band as (select *, round_even(price - price * 0.005, 8)::decimal(18,8) as lo, round_even(price + price * 0.005, 8)::decimal(18,8) as up, row_number() over (partition by symbol, side order by confirm) as k from touches),
 t as (select b.symbol, b.side, b.k, b.confirm, b.price, b.lo, b.up, min(f.i) as br from band b left join f on f.symbol = b.symbol and f.i > b.confirm and case b.side when 'buy_side' then f.high > b.up else f.low < b.lo end group by all),
 w as (select distinct symbol, side, 0::bigint as k, []::struct(c bigint, lo decimal(18,8), up decimal(18,8), br bigint)[] as act, null::bigint as confirm, null::bigint as head from t
  union all select symbol, side, k, case when j is null then list_append(live, {'c': confirm, 'lo': lo, 'up': up, 'br': br}) else live end, confirm, coalesce(j.c, confirm)
  from (select *, list_filter(live, lambda x: price between x.lo and x.up)[1] as j from (select t.*, list_filter(w.act, lambda x: x.br is null or x.br > t.confirm) as live from w join t on t.symbol = w.symbol and t.side = w.side and t.k = w.k + 1))),
 p as (select w.symbol, w.side, w.head as created, max(w.confirm) as touched, count(*) as members from w where head is not null group by 1, 2, 3),
 g as (select p.*, t.price, t.lo, t.up, t.br from p join t on t.symbol = p.symbol and t.side = p.side and t.confirm = p.created),
 judged as (select g.*, case when br is null then 'active' when (select closed_at from f where f.symbol = g.symbol and f.i = g.touched) > s.opened_at or (side = 'buy_side' and (greatest(s.pc, s.open) > up or s.close >= lo)) or (side = 'sell_side' and (least(s.pc, s.open) < lo or s.close <= up)) then 'invalidated' else 'swept' end as status
  from g left join s on s.symbol = g.symbol and s.i = g.br)
select symbol, side, round(lo::double, 6) as lower, round(up::double, 6) as upper, created as created_index, touched as touched_index, members, case when members > 1 then case side when 'buy_side' then 'equal_highs' else 'equal_lows' end else case side when 'buy_side' then 'swing_high' else 'swing_low' end end as kind, coalesce(br, -1)::bigint as breach_index, status from judged""".replace("{'c': confirm, 'lo': lo, 'up': up, 'br': br}", "struct_pack(c := confirm, lo := lo, up := up, br := br)"))),
    "pool_log": q(ST + POOLS, f"select symbol, side, {r6('price')}, created as created_index, i as bar_index, status from ({VERSIONS})"),
    "sweep_context": q(ST + POOLS + SWEPT, """, c as (select x.symbol, x.i, last_value(case when w.symbol is not null then x.i end ignore nulls) over (partition by x.symbol order by x.i rows between unbounded preceding and 1 preceding) as si
 from f x left join swept w on w.symbol = x.symbol and w.i = x.i)
select c.symbol, c.i as bar_index, case when si is null or c.i - si > 20 then 'none' when w.b and w.l then 'after_both' when w.b then 'after_buy_side' else 'after_sell_side' end as sweep_context from c left join swept w on w.symbol = c.symbol and w.i = c.si"""),
    "atr": q(ALL, f"select symbol, i as bar_index, {r6('tr')}, round(ptr::double / 14, 6) as prior_atr, round(ntr::double / 14, 6) as atr from facts"),
    "displacement": q(ALL, f"select symbol, i as bar_index, disp as displacement, {r6('body')}, {r6('span')} from facts where disp is not null"),
    "fvg": q(ALL, f"select symbol, i as bar_index, gap, {r6('glo', 'gap_low')}, {r6('ghi', 'gap_high')}, gdisp as gap_displaced from facts where gap is not null"),
    "order_blocks": q(ALL, f"select symbol, i as bar_index, blk as block, {r6('blo', 'block_low')}, {r6('bhi', 'block_high')}, bi as block_index from facts where blk is not null"),
    "dealing_range": q(ALL, f"select symbol, i as bar_index, rst as range_status, {r6('rlo', 'range_low')}, {r6('rhi', 'range_high')}, coalesce(rdir, '-') as range_direction, coalesce(rcf, -1)::bigint as range_confirm from facts"),
    "pd_class": q(ALL, "select symbol, pd as pd_class, count(*) as n, sum(i)::bigint as indexes from facts group by 1, 2"),
    "pd_arrays": q(ALL + POOLS, f"""select symbol, bar_index, kind, {r6('a', 'low')}, {r6('b', 'high')}, {r6('m', 'price')}, {zone_class('a')} as low_class, {zone_class('b')} as high_class, {zone_class('m')} as price_class from (
 select symbol, i as bar_index, 'fvg' as kind, glo as a, ghi as b, (glo + ghi) * 0.5 as m, rlo, rhi from facts where gap is not null
 union all select symbol, i, 'order_block', blo, bhi, (blo + bhi) * 0.5, rlo, rhi from facts where blk is not null union all select symbol, i, 'displacement', close, close, close, rlo, rhi from facts where disp is not null
 union all select v.symbol, v.i, 'liquidity_pool', v.price, v.price, v.price, x.rlo, x.rhi from ({VERSIONS}) v join facts x on x.symbol = v.symbol and x.i = v.i
 union all select p.symbol, p.breach, 'sweep', {EXTREME}, {EXTREME}, {EXTREME}, x.rlo, x.rhi from pools p join facts x on x.symbol = p.symbol and x.i = p.breach where p.status = 'swept')"""),
    "retracement": q(ALL, f"select symbol, i as bar_index, {r6('olo', 'ote_low')}, {r6('ohi', 'ote_high')}, opos as ote_position from facts"),
    "structure_shift": q(ALL, f"select symbol, i as bar_index, shift, round((case shift when 'bullish' then plh else pll end)::double, 6) as shift_level from facts where shift is not null"),
    "shift_context": q(ALL + POOLS + SWEPT, f""",
c as (select x.*, last_value(case when w.symbol is not null then x.i end ignore nulls) over (partition by x.symbol order by x.i rows between unbounded preceding and 1 preceding) as si from facts x left join swept w on w.symbol = x.symbol and w.i = x.i),
turns as (select *, case shift when 'bullish' then 'buy_side' else 'sell_side' end as lside, case shift when 'bullish' then ph else pl end as lprice, case shift when 'bullish' then phc else plc end as lconf from c where shift is not null)
select symbol, i as bar_index, shift, 'displacement' as relation, disp as detail, {r6('close', 'low')}, {r6('close', 'high')}, i as ref_index, {zone_class('close')} as price_class from turns
union all select s.symbol, s.i, shift, 'pool', v.status, {r6('v.price', 'low')}, {r6('v.price', 'high')}, v.created, {zone_class('v.price')} from turns s join ({VERSIONS}) v on v.symbol = s.symbol and v.i = s.i and v.side = s.lside and v.price = s.lprice and v.created <= s.lconf
union all select s.symbol, s.i, shift, 'swept_pool', p.side, {r6('p.price', 'low')}, {r6('p.price', 'high')}, p.breach, '-' from turns s join pools p on p.symbol = s.symbol and p.status = 'swept' and p.breach = s.si where s.i - s.si <= 20
union all select symbol, i, shift, 'gap', gap, {r6('glo')}, {r6('ghi')}, i, {zone_class('(glo + ghi) / 2')} from turns where gap = shift
union all select symbol, i, shift, 'order_block', blk, {r6('blo')}, {r6('bhi')}, bi, {zone_class('(blo + bhi) / 2')} from turns where blk = shift"""),
    "breakers": q(ALL + BROKEN, "select symbol, pub as published_index, blk as direction, h as hit_index, rejection, case when rejection = '-' then case blk when 'bullish' then 'bearish' else 'bullish' end else '-' end as breaker from broken"),
    "mitigations": q(ALL + BROKEN, """, m as (select b.symbol, b.pub, min(x.i) as h from blocks b join facts x on x.symbol = b.symbol and x.i > b.pub and x.high > b.blo and x.low < b.bhi and x.opened_at >= b.bknown group by 1, 2)
select b.symbol, b.pub as published_index, b.blk as direction, m.h as hit_index, round(greatest(b.blo, x.low)::double, 6) as overlap_low, round(least(b.bhi, x.high)::double, 6) as overlap_high,
 round((least(b.bhi, x.high) - greatest(b.blo, x.low))::double, 6) as overlap_size from blocks b join m on m.symbol = b.symbol and m.pub = b.pub join facts x on x.symbol = b.symbol and x.i = m.h
 where not exists (select 1 from broken k where k.symbol = b.symbol and k.pub = b.pub and k.rejection = '-' and k.h <= m.h)"""),
    "mtf_confluence": q(B15 + CONFLUENCE, "select symbol, i as bar_index, d1 as direction_1h, d4 as direction_4h, coalesce(c1, -1)::bigint as cursor_1h, coalesce(c4, -1)::bigint as cursor_4h, confluence from conf"),
    "htf_evidence": q(B4H + structure() + FACTS + POOLS + EVIDENCE + "," + bars("1 hour", "p"), f""", j as (select p.symbol, p.i, max(t.i) as cur from pf p left join total t on t.symbol = p.symbol and t.closed_at <= p.opened_at group by 1, 2)
select j.symbol, j.i as bar_index, coalesce(j.cur, -1)::bigint as cursor_4h, {", ".join(f"coalesce(t.{k}, 0)::bigint as {k}" for k in KINDS)}, {", ".join(f"(j.cur is not null)::bigint as {k}" for k in LATEST)} from j left join total t on t.symbol = j.symbol and t.i = j.cur"""),
    "registry_status": q(B4H, """select symbol, case when symbol in ('click', 'view', 'purchase') then 'HALAL' else 'UNKNOWN' end as status, case when symbol in ('click', 'view', 'purchase') then 'listed_in_allow_list' else 'absent_from_allow_list' end as status_reason, count(*) as n from f group by 1, 2, 3"""),
    "scores": q(ALL + SCORED, """select symbol, i as bar_index, score::bigint as score, passed, case when status <> 'HALAL' then rtrim(repeat('gated_unknown,', 11), ',') else concat_ws(',', 'halal_status',
 case when confluence in ('BULLISH', 'BEARISH') then 'mtf_directional' when confluence = 'INSUFFICIENT_CONTEXT' then 'mtf_insufficient' else 'mtf_' || lower(confluence) end, 'missing_evidence', case when disp is not null then 'displacement_present' else 'missing_evidence' end,
 case when swept then 'sweep_present' else 'missing_evidence' end, case when gap is not null then 'fvg_present' else 'missing_evidence' end, case when blk is not null then 'order_block_present' else 'missing_evidence' end, 'missing_evidence', 'missing_evidence',
 case when pd = 'INSUFFICIENT_CONTEXT' then 'pd_insufficient' else 'pd_' || lower(pd) end, case when opos = 'INSUFFICIENT_CONTEXT' then 'ote_insufficient' else 'ote_' || lower(replace(opos, '_OTE', '')) end) end as score_reasons from sig"""),
    "eligibility": q(ALL + SCORED, """select symbol, i as bar_index, bias, case when status = 'HALAL' and passed then 'ELIGIBLE' else 'NOT_ELIGIBLE' end as eligibility, (longs + shorts)::bigint as n_votes,
 case when status <> 'HALAL' then 'gated_unknown' else concat_ws(',', case when passed then 'halal_and_threshold' else 'threshold_not_met' end,
 case confluence when 'BULLISH' then 'mtf_long' when 'BEARISH' then 'mtf_short' when 'MIXED' then 'mtf_mixed' when 'NEUTRAL' then 'mtf_neutral' else 'mtf_insufficient' end,
 case when not ready then 'structure_unready' when trend = 'bullish' then 'structure_long' when trend = 'bearish' then 'structure_short' else 'structure_ranging' end,
 case when eu is not null then 'structure_event_long' end, case when ed is not null then 'structure_event_short' end, case blk when 'bullish' then 'order_block_long' when 'bearish' then 'order_block_short' else 'order_block_missing' end,
 case when opos = 'INSIDE_OTE' and rdir = 'bullish' then 'ote_long' when opos = 'INSIDE_OTE' and rdir = 'bearish' then 'ote_short' else 'ote_missing' end, 'mss_missing', 'breaker_missing', 'mitigation_missing',
 case when bias <> 'NEUTRAL' then null when confluence = 'MIXED' or (longs > 0 and shorts > 0) then 'conflicting_evidence' else 'no_directional_evidence' end) end as eligibility_reasons from sig"""),
    "signals": q(ALL + SCORED, """select symbol, i as bar_index, signal, case when again then 'duplicate_setup' when signal = 'BUY_SIGNAL' then concat_ws(',', 'halal_asset', 'sqs_threshold_passed', 'long_bias', case when confluence = 'BULLISH' then 'mtf_alignment' end,
 case when disp = 'bullish' then 'bullish_displacement' end, case when pd = 'DISCOUNT' then 'discount_context' end, case when opos = 'INSIDE_OTE' then 'ote_context' end)
 when signal = 'BEARISH_AVOID' then 'halal_asset,sqs_threshold_passed,bearish_spot_avoid' when status <> 'HALAL' then 'not_halal' when not passed then 'sqs_below_threshold' when bias = 'NEUTRAL' then 'neutral_bias' else 'missing_required_evidence' end as reasons from sig"""),
    "outcome_rows": q(B15 + OUTCOMES, f"select symbol, i as bar_index, outcome, {r6('mx', 'mfe_price')}, coalesce(mxi, -1)::bigint as mfe_index, {r6('mn', 'mae_price')}, coalesce(mni, -1)::bigint as mae_index, {r6('fr', 'final_return')} from o2"),
    "outcome_running": q(ALL + PUBLISHED, """, e as (select symbol, i, 1 as b, 0 as d, 0 as w from pub union all select symbol, i + 10, 0, 1, (outcome = 'WIN')::int from pub where outcome <> 'OPEN'),
 g as (select symbol, i, sum(b) as b, sum(d) as d, sum(w) as w from e group by 1, 2)
select f.symbol, f.i as bar_index, (sum(coalesce(b, 0) - coalesce(d, 0)) over w)::bigint as open, (sum(coalesce(d, 0)) over w)::bigint as finalized, (sum(coalesce(g.w, 0)) over w)::bigint as win from f left join g on g.symbol = f.symbol and g.i = f.i window w as (partition by f.symbol order by f.i)"""),
    "outcome_log": q(ALL + PUBLISHED, """, x as (select p.symbol, p.i, max(f.i) - p.i as step from pub p join f on f.symbol = p.symbol and f.i between p.i and p.i + 10 group by 1, 2)
select case when step = 0 then 'created' when step = 10 then 'completed' else 'evaluated' end as version, count(*) as n, sum(step)::bigint as steps from x group by 1"""),
    "volume_ratio": q(B15, f"select symbol, i as bar_index, round(a, 6) as volume_average, round(volume / a, 6) as volume_ratio from (select *, case when i >= 19 then avg(volume::double) {PART} rows between 19 preceding and current row) end as a from f)"),
    "ema_rsi": recursive(q(B1H + EMA, """select symbol, i as bar_index, round(e20, 6) as ema_20, round(e50, 6) as ema_50, round(case when g = 0 and l = 0 then 50 when l = 0 then 100 else 100 - 100 / (1 + g / l) end, 6) as rsi from r""")),
    "attribution": q(ALL + PUBLISHED, "select symbol, i as bar_index, combination, case when labels = '' then 0 else len(string_split(labels, '+')) end::bigint as n_labels from pub"),
    "performance": q(ALL + PUBLISHED, dimensions({"symbol": "symbol", "timeframe": "timeframe", "month": "month", "combination": "combination"}, "pub", f"{SUFFICIENT}, {STATS}, {RETURN}")
        + f"\nunion all select 'label', l, {SUFFICIENT}, {STATS}, {RETURN} from (select unnest(string_split(labels, '+')) as l, outcome, fr from pub where labels <> '') group by l"),
    "performance_ranks": q(ALL + PUBLISHED, """, g as (select combination, avg(fr) filter (where outcome <> 'OPEN') as a from pub group by 1 having count(*) filter (where outcome <> 'OPEN') >= 10)
select (select combination from g order by a desc, combination limit 1) as best, (select combination from g order by a, combination limit 1) as worst"""),
    "monthly_review": q(ALL + PUBLISHED, f""", m as (select month, {STATS}, {RETURN}, count(*) filter (where outcome = 'WIN')::double / nullif(count(*) filter (where outcome <> 'OPEN'), 0) as wr from pub group by 1)
select month, coalesce(lag(month) over (order by month), '-') as previous, total, finalized, win_rate, avg_return, round(case when finalized >= 10 and lag(finalized) over (order by month) >= 10 then wr - lag(wr) over (order by month) end, 6) as win_rate_change from m"""),
    "regimes": q(B15 + REGIME, f"select symbol, i as bar_index, {r6('er', 'efficiency')}, {r6('vr', 'volatility')}, coalesce(regime, '-') as regime from regime"),
    "walk_forward_plan": q(WINDOWS, f"select {KEY}, window_id, window_id * 25 as first, window_id * 25 + 50 as split, window_id * 25 + 74 as last from plan"),
    "walk_forward": q(SEGMENTS, "select symbol, window_id, segment, total, open, win, loss, flat, finalized, win_rate, round(ar, 5) as avg_return from seg"),
    "stability": q(SEGMENTS, """select symbol, count(*) as windows, count(*) filter (where ok) as sampled, count(*) filter (where ok and ar > 0) as positive, count(*) filter (where ok and ar < 0) as negative,
 case when count(*) filter (where ok) > 1 then round(max(wr) filter (where ok) - min(wr) filter (where ok), 5) end as win_spread, case when count(*) filter (where ok) > 1 then round(max(ar) filter (where ok) - min(ar) filter (where ok), 5) end as return_spread,
 case when count(*) filter (where ok) > 1 then round(max(amfe) filter (where ok) - min(amfe) filter (where ok), 5) end as mfe_spread, case when count(*) filter (where ok) > 1 then round(max(amae) filter (where ok) - min(amae) filter (where ok), 5) end as mae_spread,
 coalesce(arg_min(window_id, struct_pack(a := -ar, b := window_id)) filter (where ok), -1)::bigint as best, coalesce(arg_min(window_id, struct_pack(a := ar, b := window_id)) filter (where ok), -1)::bigint as worst,
 case when count(*) filter (where ok) < 3 then 'UNDERSAMPLED' when count(*) filter (where ok and wr >= 0.5 and ar >= 0) = count(*) filter (where ok) and max(wr) filter (where ok) - min(wr) filter (where ok) <= 0.5 then 'STABLE' else 'WEAK' end as status
 from (select *, finalized >= 10 as ok from seg where segment = 'validation') group by 1"""),
    "degradation": q(CHANGES, "select symbol, window_id, round(dw, 6) as win_rate_change, round(da, 5) as avg_return_change, sure as \"both\" from ch"),
    "degradation_summary": q(CHANGES, "select symbol, count(*) as windows, count(*) filter (where sure) as comparable, round(avg(dw) filter (where sure), 5) as mean_win_rate_change, round(avg(da) filter (where sure), 5) as mean_avg_return_change from ch group by 1"),
    "out_of_sample": q(WALKED, dimensions({"symbol": "symbol", "timeframe": "timeframe", "combination": "combination", "month": "month", "regime": "regime"}, "val", f"{SUFFICIENT}, {STATS}, {RETURN}")),
    "cells": q(WALKED, f"select *, case pattern when 'WINNER' then 'STRENGTH' when 'LOSER' then 'WEAKNESS' else 'UNDETERMINED' end as diagnosis from ({dimensions(CELLS, 'val', f'{CELL}, {STATS}')})"),
    "findings": q(WALKED, f'select dimension, "group", finalized, win_rate from ({dimensions(CELLS, "val", f"{CELL}, {STATS}")}) where pattern = \'LOSER\''),
    "compare_variants": f"""with base as ({variant(30)}), cand as ({variant(45)})
select dimension, "group", coalesce(a.n, 0) as base_sample, coalesce(b.n, 0) as cand_sample, round(a.wr, 6) as base, round(b.wr, 6) as cand, round(b.wr - a.wr, 6) as difference, coalesce(a.n, 0) >= 30 and coalesce(b.n, 0) >= 30 as conclusive
from base a full join cand b using (dimension, "group")""",
    "threshold_grid": q(ALL + SCORED, """, v as (select * from (values ('low', 30), ('middle', 40), ('high', 50)) t(variant, threshold))
select variant, symbol, count(*) as n from (select distinct variant, symbol, bias, c1, c4, case when olo is not null then rlo end as a, case when olo is not null then rhi end as b, case when olo is not null then rcf end as c,
 case when blk is not null then i end as d, case when gap is not null then i end as e, case when disp is not null then i end as g from sig join v on sig.score >= v.threshold where status = 'HALAL' and bias = 'LONG_BIAS') group by 1, 2"""),
    "chart_primitives": recursive(q(ALL + SCORED + OUTCOMES + PRIMITIVES + EMA + BOUGHT, f"select {KEY}, kind, name, i as bar_index, coalesce(e, -1) as end_index, {r6('low')}, {r6('high')} from drawn")),
    "candle_metrics": q(ALL, "select symbol, i as bar_index, coalesce(candle, 'doji') as candle, round((close - low)::double / nullif(span, 0)::double, 6) as close_location, round(body::double / nullif(ptr::double / 14, 0), 6) as body_atr, round(span::double / nullif(ptr::double / 14, 0), 6) as span_atr from facts"),
    "fingerprints": q(B15, f""", digests as (select symbol || ':15m' as series_key, sha256(format('{{{{"close":"{{}}","high":"{{}}","low":"{{}}","open":"{{}}","timestamp":"{{}}","volume":"{{}}"}}}}', close::varchar, high::varchar, low::varchar, open::varchar, strftime(opened_at, '%Y-%m-%dT%H:%M:%S.%gZ'), volume::decimal(18,8)::varchar)) as h from f),
 parts as (select series_key, count(*) as n, {", ".join(f"sum(('0x' || substr(h, {8 * k + 1}, 8))::bigint)::hugeint as p{k}" for k in range(8))} from digests group by 1),
 c7 as (select *, p7 // 4294967296 as o7 from parts), {", ".join(f"c{k} as (select *, (p{k} + o{k + 1}) // 4294967296 as o{k} from c{k + 1})" for k in reversed(range(7)))}
select series_key, n, {" || ".join(f"format('{{:08x}}', ((p{k}{f' + o{k + 1}' if k < 7 else ''}) % 4294967296)::bigint)" for k in range(8))} as fingerprint from c0"""),
    "price_domain": q(ALL + POOLS + PRIMITIVES, f"select {KEY}, round(case when a = b then a - 1 else a end, 6) as low, round(case when a = b then b + 1 else b end, 6) as high from (select symbol, min(low) as a, max(high) as b from (select symbol, low::double as low, high::double as high from f union all select symbol, low, high from prim where kind <> 'overlay') group by 1)"),
    "ledger_stats": q(ALL + PUBLISHED, f"select 'all' as month, {STATS}, {RETURN} from pub\nunion all select month, {STATS}, {RETURN} from pub group by month"),
}
# the chunked chain gives the rows of the whole one
ORACLES |= {f"chunked_{name}": ORACLES[plain] for name, plain in (("structure", "structure_rows"), ("blocks", "order_blocks"), ("signals", "signals"), ("outcomes", "outcome_rows"))}
ORACLES["streamed_signals"] = ORACLES["signals"]


def daily(sql: str) -> str:
    """The SQL of a query over events, over daily bars of order lines with their settings."""
    lines = "select 'Maker' || substr(p_brand, 7, 1) as symbol, l_shipdate as ts, l_orderkey * 10 + l_linenumber as tie, round(l_extendedprice / l_quantity, 4)::decimal(18,8) as px from lineitem join part on l_partkey = p_partkey"
    swaps = {
        "select event_type as symbol, ts, event_id as tie, value::decimal(18,8) as px from events": lines, "interval '15 minutes'": "interval '1 day'", "interval '1 hour'": "interval '3 days'", "interval '4 hours'": "interval '7 days'",
        "('click', 'view', 'purchase')": "('Maker1', 'Maker2', 'Maker3')", "'15m' as timeframe": "'1d' as timeframe", "score >= 30": "score >= 20", "score >= 45": "score >= 35", "finalized >= 10": "finalized >= 3",
        ") < 20 then 'UNDERSAMPLED'": ") < 4 then 'UNDERSAMPLED'", "filter (where ok) < 3 then": "filter (where ok) < 2 then", "coalesce(a.n, 0) >= 30 and coalesce(b.n, 0) >= 30": "coalesce(a.n, 0) >= 4 and coalesce(b.n, 0) >= 4",
        "max(finalized) filter (where segment = 'validation') >= 10": "max(finalized) filter (where segment = 'validation') >= 3", "max(finalized) filter (where segment = 'development') >= 10": "max(finalized) filter (where segment = 'development') >= 3",
        "lag(finalized) over (order by month) >= 10": "lag(finalized) over (order by month) >= 3",
    }
    for old, new in swaps.items():
        sql = sql.replace(old, new)
    return sql


ORACLES |= {f"{name}_daily": daily(ORACLES[name]) for name in ("monthly_review", "stability", "degradation", "degradation_summary", "cells", "findings", "compare_variants")}
