"""Readers of tables, trees, logs, coverage and policies; writers of versioned tables."""
