"""Spark-native analytics over source-like text: clones, reachability, complexity, slices and diffs."""

__version__ = "0.1.0"
