"""Builders of SQL text as Spark expressions."""
