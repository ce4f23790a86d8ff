"""Spark-native analytics for vehicle-bus captures."""
