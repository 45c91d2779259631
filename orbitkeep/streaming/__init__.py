"""Structured Streaming twins of the operators that follow a log."""
