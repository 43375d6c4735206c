"""PySpark jobs that prepare metered solar-generation time series."""

__version__ = "0.1.0"
