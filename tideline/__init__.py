"""Timed-text evidence engine on Spark."""
