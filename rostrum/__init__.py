"""Rostrum: a Spark-native engine for corpora of dated, attributed documents."""
