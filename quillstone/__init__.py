"""Spark-native statistics over tokenised, line-structured corpora."""
