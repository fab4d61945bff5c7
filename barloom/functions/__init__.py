"""Column helpers that all layers share."""
