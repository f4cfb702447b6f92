"""Localization and terminology analytics as PySpark DataFrame jobs."""
