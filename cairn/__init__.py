"""cairn: a Spark-native engine for file-estate deduplication, storage analytics and corpus work."""

__version__ = "0.1.0"
