"""Operators for training data, each apart from the rest of the library: nothing outside this subpackage imports it."""
