"""Operators for training-data problems of text; nothing else in the library imports this package."""
