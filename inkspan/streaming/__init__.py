"""Structured Streaming forms of progress, rate limits, sessions and one-time answers."""
