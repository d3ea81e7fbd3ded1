"""Spark-native analytics for studying who or what wrote a program."""
