"""Operators for preparing model-training data. Nothing outside this subpackage imports it."""

MODULES = ["packing", "splits", "neardup", "overlap", "vectors", "leaks", "tokens", "subjects"]
