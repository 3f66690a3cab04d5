"""Loamworks: a Spark-first engine for repository and corpus analytics."""

__version__ = "0.1.0"
