"""Readers, sinks and table schemas."""
