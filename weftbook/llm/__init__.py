"""Operators of a training-data pipeline: tokenising, packing, extraction, filtering, deduplication, sharding."""
