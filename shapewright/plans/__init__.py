"""Definitions, identification, and construction of JSON."""
