"""Operators for training-data work on multilingual text. Nothing outside this subpackage imports it."""
