"""A Spark-native engine for source-text, finding and event corpora."""
