"""Operators for preparing training data: one module an operator, and queries.py."""
