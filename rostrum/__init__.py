"""Rostrum: a PySpark-native analytics engine for discourse corpora.

Every operator is a function from DataFrame to DataFrame, configured by plain
arguments, so that Catalyst sees one declarative plan from scan to sink.
"""
