"""Structured Streaming forms of the frame stream."""
