"""Spark-native analytics for scored events: functions over DataFrames, with column names as parameters."""
