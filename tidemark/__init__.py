"""Spark-native analytics over mixed-frequency observation streams."""
