"""lumenfold: finds periodic dips in time-series photometry on Spark."""

__version__ = "0.1.0"
