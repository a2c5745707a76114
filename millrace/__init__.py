"""A Spark-native record dataflow and analytics engine."""
