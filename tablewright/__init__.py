"""Preparation, quality checks, scoring and repair of event tables on Spark."""
