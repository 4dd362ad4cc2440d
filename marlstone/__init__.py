"""Spark-native analytics: every operator takes DataFrames and returns DataFrames."""
