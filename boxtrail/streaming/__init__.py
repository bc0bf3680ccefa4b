"""Incremental scoring of a growing result log."""
