"""Operators for training data, each by a method of its own. Nothing else in the package imports them."""
