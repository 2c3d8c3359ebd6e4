"""Scholarly event analytics on Spark: sources, cleaning, lookup, matching, statistics."""
