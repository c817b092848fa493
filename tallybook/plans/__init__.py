"""Composed jobs, the registered queries and their SQL counterparts."""
