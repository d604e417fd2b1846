"""Operators on captures and their lines."""
