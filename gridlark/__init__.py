"""Spark-native analytics over sheets and tables whose cells need not share a type."""
