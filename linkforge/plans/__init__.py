"""Queries over the demonstration world, each with SQL for another engine to check it by."""
