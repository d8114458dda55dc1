"""Operators for training text and for groups of matched records; nothing outside imports this subpackage."""
