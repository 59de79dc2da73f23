"""Weftline: forecasting pipelines over panels of series, on Spark DataFrames."""
