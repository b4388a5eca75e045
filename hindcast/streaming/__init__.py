"""Structured Streaming twins of the bar and score operators."""
