"""Operators of a training-data pipeline: deduplication, decontamination, filtering,
mixing, token output, sharding and scoring over whole document tables."""
