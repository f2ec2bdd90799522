"""Spark-native analytics over a long-term conversational memory."""
