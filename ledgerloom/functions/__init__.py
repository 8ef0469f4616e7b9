"""Spark-native ledger analytics."""
