"""tracewell: Spark-native analytics for agent conversation logs."""
