"""webloom: stored web pages and agent action logs as Spark DataFrames."""

__version__ = "0.1.0"
