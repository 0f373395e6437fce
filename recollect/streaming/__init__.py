"""Structured Streaming forms of what the engine does while rows arrive."""
