"""Sliced evaluation of model predictions on Spark DataFrames."""
