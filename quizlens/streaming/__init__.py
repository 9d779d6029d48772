"""Streaming forms of resumable work."""
