"""Modelling and evaluation on DataFrames and Spark ML."""
