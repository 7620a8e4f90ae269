"""Readers, sinks and status of the catalogue tables."""
