"""Relational operators: joins, windows, rollups, graph steps, similarity."""
