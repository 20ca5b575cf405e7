"""Spark-native feature engineering and model evaluation for tabular and molecular data."""

__version__ = "0.1.0"
