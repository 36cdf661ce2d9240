"""Operators on text for training data (problems 1 and 3 to 8). Nothing outside this package imports it."""
