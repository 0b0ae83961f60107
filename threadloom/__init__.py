"""Threadloom: analytics over time-ordered conversations as plain Spark DataFrame pipelines."""
