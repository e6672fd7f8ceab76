"""Compositions of operators, and the adapter onto the test tables."""
