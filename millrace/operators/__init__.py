"""Operators over keyed tables, graphs, metrics, ranges and learning data."""
