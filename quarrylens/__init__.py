"""A Spark-native engine for corpus detection and risk analytics."""
