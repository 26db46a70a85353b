"""Structured Streaming forms of the event bus."""
