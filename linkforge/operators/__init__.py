"""Joins, matching strategies, decisions, groups and reports: DataFrame to DataFrame."""
