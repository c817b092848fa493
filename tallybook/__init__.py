"""Bookkeeping analytics as Spark DataFrame operators."""
