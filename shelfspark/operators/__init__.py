"""Operators: one module per family, each a set of DataFrame functions."""
