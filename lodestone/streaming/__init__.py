"""Structured Streaming: windows over events and keyed state."""
