"""Longitudinal cohort analytics as Spark DataFrame plans."""
