"""Operators of a training-data pipeline: scoring, cleaning, deduplication, mixing, packing."""
