"""Compositions of operators: stand-in tables, feature views, evaluation, golden sets."""
