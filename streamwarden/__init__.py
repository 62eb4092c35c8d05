"""Data-quality and observability jobs for event streams and tables, on Spark."""

__version__ = "0.1.0"
