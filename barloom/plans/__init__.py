"""plans of the candle engine."""
