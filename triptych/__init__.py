"""Build and score contrastive translation tables with Spark DataFrames.

A *triple* is one source sentence with three candidate translations:
A (idiomatic), B (descriptive) and C (wrong literal).
"""
