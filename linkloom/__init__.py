"""Spark-native link analysis over observation documents and tables."""
