"""Readers, staging tables and sinks."""
