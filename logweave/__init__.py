"""Spark-first analytics over structured event logs."""
