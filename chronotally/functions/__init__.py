"""Scalar functions: identifiers, times, text."""
