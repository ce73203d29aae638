"""Annotate tables of free text with Spark and report on the result."""
