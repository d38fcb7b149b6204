"""Readers that turn bytes and JSON into rows."""
