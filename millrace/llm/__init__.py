"""Operators for training data: text and code. Nothing else in the library imports this subpackage."""
