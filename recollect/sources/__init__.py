"""Readers: source trees, unified diffs, benchmark conversations."""
