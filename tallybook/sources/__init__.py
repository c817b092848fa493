"""Scans and sinks: files, records, configuration, keyed tables, external reports."""
