"""Panel / time-series feature and forecast-evaluation operators for PySpark DataFrames."""

__version__ = "0.1.0"
