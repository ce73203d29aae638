"""Whole plans: the annotation of a report and the registered queries."""
