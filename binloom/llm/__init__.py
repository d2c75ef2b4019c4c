"""Operators for building large text training sets; nothing else in the library imports this subpackage."""
