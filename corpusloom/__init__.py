"""corpusloom: a Spark-native engine for large, dated text archives."""

__version__ = "0.1.0"
