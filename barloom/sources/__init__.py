"""sources of the candle engine."""
