"""retentio: entity x period retention and churn analytics on Spark DataFrames."""

__version__ = "0.1.0"
