"""Structured Streaming form of ingestion."""
