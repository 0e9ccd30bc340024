"""Structured Streaming operators and the end-to-end alert stream."""
