"""Iterative methods built from the operators."""
