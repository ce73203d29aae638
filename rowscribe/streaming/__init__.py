"""Structured Streaming versions of intake, annotation and job events."""
