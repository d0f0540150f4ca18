"""Operators of a training-data pipeline: tokens, near copies, quality, privacy and packing."""
