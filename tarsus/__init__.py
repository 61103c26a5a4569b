"""tarsus: a Spark-native engine for embedding evaluation and dataset auditing."""

__version__ = "0.1.0"
