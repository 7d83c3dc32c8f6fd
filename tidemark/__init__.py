"""Tidemark: panel forecasting pipelines as Spark DataFrame jobs."""

from tidemark.series import Series

__all__ = ["Series"]
