"""Analytics over reasoning traces, their fact graphs and their verification results, on Spark."""

__version__ = "0.1.0"
