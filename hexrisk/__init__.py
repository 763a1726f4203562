"""Spatio-temporal risk analytics as plain PySpark DataFrame jobs."""
