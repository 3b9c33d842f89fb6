"""polarity: polarity analytics over large text tables on Spark."""

__version__ = "0.1.0"
