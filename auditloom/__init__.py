"""Spark-native analytics over code corpora, model-call logs, traces and tool calls.

Every operator takes DataFrames (or columns) and returns DataFrames (or columns), so
operators chain with ``DataFrame.transform`` and stay lazy until the caller acts.
"""
