"""operators of the candle engine."""
