"""streaming of the candle engine."""
