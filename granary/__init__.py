"""Granary: DataFrame-first operators for evidence-bearing tables, text and property graphs on Spark."""
