"""Alarm analytics on Spark: DataFrame operators, models and batch jobs."""
