"""leadloom: a Spark-native engine for lead, event and document data."""

__version__ = "0.1.0"
