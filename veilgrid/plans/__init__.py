"""Whole scans, and the registered queries with their SQL."""
