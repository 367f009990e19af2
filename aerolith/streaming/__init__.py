"""Structured Streaming variants of the hourly weather operators."""
