"""Operators for training data: percentiles of huge columns, tokenizer encoding, evaluation leaks, personal information."""
