"""Spark-native discovery of short, readable linear laws from tables and telemetry."""
