"""Publication and corpus analytics on Spark DataFrames."""

__version__ = "1.0.0"
