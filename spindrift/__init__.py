"""Spindrift: Spark-native processing of language-model training and evaluation data."""
