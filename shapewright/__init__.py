"""Turns semi-structured text into typed DataFrames, as Spark plans."""
