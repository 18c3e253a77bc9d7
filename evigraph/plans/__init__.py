"""Queries over the given tables, and how those stand in for the engine's shapes."""
