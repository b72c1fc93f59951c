"""Structured Streaming over the same logs."""
