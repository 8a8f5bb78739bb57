"""A Spark-native engine for mining, validating, classifying and screening code-change data."""
