"""Spark-native analytics over timestamped conversational evidence."""
