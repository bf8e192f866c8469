"""Operators for building training data: deduplication, filtering, decontamination, mixing, scoring and token output."""
