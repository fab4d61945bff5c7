"""Settings of every layer; bound as literals when a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    # Names apart, the defaults of the methods.
    fractal_length: int = 5
    pool_tolerance_bps: float = 0.0
    atr_period: int = 14
    min_body_atr: float = 1.0
    min_range_atr: float = 1.5
    close_location: float = 0.70
    atr_floor: float = 0.0
    sweep_lookback: int = 20
    min_gap_size: float = 0.0
    require_displacement: bool = False
    candidate_lookback: int = 10
    block_zone: str = "range"
    block_nearest: bool = True
    block_structure: str = "bos_or_choch"
    require_fvg: bool = False
    allow_doji: bool = False
    equilibrium_half_width: float = 0.0
    retracement: tuple[float, float] = (0.62, 0.79)
    higher: tuple[str, ...] = ("1h", "4h")
    registry_mode: str = "allow"
    score_threshold: int = 75
    horizon: int = 10
    ema_periods: tuple[int, ...] = (20, 50)
    rsi_period: int = 14
    volume_period: int = 20
    regime_period: int = 20
    trending_ratio: float = 0.30
    high_volatility: float = 1.5
    low_volatility: float = 0.75
    minimum_finalized: int = 10
    development_bars: int = 50
    validation_bars: int = 25
    step_bars: int = 25
    stable_win_rate: float = 0.5
    minimum_windows: int = 3
    maximum_win_rate_spread: float = 0.5
    cell_minimum: int = 20
    strong_win_rate: float = 0.60
    weak_win_rate: float = 0.40
    compare_minimum: int = 30
    #: Bars of a chunk where series are long; None runs each series as a whole.
    chunk_bars: int | None = None

    def __post_init__(self) -> None:
        if self.fractal_length < 3 or self.fractal_length % 2 == 0:
            raise ValueError("fractal_length is an odd number from 3")
        if not 0 <= self.pool_tolerance_bps <= 1000:
            raise ValueError("pool_tolerance_bps lies in 0..1000")
        if not 0 <= self.equilibrium_half_width <= 0.5:
            raise ValueError("equilibrium_half_width lies in 0..0.5")
        if self.step_bars < self.validation_bars:
            raise ValueError("steps are at least as long as validation")
        if min(self.atr_period, self.horizon, self.candidate_lookback, self.validation_bars, self.development_bars) < 1:
            raise ValueError("periods start at 1")
        if not 0 <= self.score_threshold <= 100:
            raise ValueError("score_threshold lies in 0..100")
        if not all(0 < x < float("inf") for x in (self.min_body_atr, self.min_range_atr)):
            raise ValueError("bodies and ranges are measured by numbers above zero")
        if not 0 < self.retracement[0] < self.retracement[1] < 1:
            raise ValueError("retracements lie between 0 and 1, the lower one first")
        if self.chunk_bars is not None and self.chunk_bars < 1:
            raise ValueError("chunks have one bar at least")


#: The settings that a candidate may change.
SURFACES = ("score_threshold", "atr_period", "min_body_atr", "min_range_atr", "retracement")


def varied(cfg: Config, deltas: dict[str, tuple[object, object]]) -> Config:
    """A candidate: cfg with settings of SURFACES changed, {name: (old, new)}; every old value must be the one that cfg has."""
    if not deltas:
        raise ValueError("a candidate changes at least one setting")
    known = {f.name for f in fields(cfg)}
    for name, (old, _) in deltas.items():
        if name not in known:
            raise ValueError(f"{name} is no setting")
        if name not in SURFACES:
            raise ValueError(f"{name} is not among the settings that may change: {', '.join(SURFACES)}")
        if getattr(cfg, name) != old:
            raise ValueError(f"{name} is {getattr(cfg, name)!r}, not {old!r}")
    return replace(cfg, **{name: new for name, (_, new) in deltas.items()})
