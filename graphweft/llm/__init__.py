"""Operators for building training data; nothing outside imports this subpackage."""
