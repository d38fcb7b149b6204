"""Structured Streaming forms of the match and of stateful decoding."""
