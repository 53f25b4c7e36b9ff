"""Spark-first analytics for labelled grids, depth curves, instance tables and pore networks."""

__version__ = "0.1.0"
