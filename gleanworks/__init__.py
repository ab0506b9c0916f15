"""gleanworks: a PySpark-native engine for posting records and training-data pipelines."""

__version__ = "0.1.0"
