"""Subpackage of inkwell; see README.md."""
