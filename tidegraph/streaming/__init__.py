"""Structured Streaming: transaction lines as they arrive."""
