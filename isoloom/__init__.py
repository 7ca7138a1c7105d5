"""Spark-native transcript and splice-junction analytics."""
