"""A Spark-native engine for corpora of linked markdown notes."""
