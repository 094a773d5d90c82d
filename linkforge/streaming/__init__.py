"""Structured Streaming counterparts of polled counts."""
