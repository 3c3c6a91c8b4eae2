"""Operators for training data: filters, duplicate removal, tokens and formats."""
