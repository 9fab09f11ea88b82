"""Operators of a training-data pipeline: tokens, duplicates, packing, chat text, search, extraction, models."""
