"""Causeway: causal time-series panels, walk-forward models and policies as Spark jobs."""

__version__ = "0.1.0"
