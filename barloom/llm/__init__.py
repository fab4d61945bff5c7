"""Operators for preparing text corpora: dedup, mixing, masking, tokens, packing, scoring."""
