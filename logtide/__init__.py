"""A Spark-native engine for ordered event logs and text corpora."""
