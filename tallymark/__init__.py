"""Watermark evaluation and corpus processing on Spark DataFrames."""
