"""Operators over entities, edges, deltas, change logs, findings and work, as DataFrame functions."""
