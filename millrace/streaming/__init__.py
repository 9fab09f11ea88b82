"""Structured Streaming forms of the metric and keyed-table operators."""
