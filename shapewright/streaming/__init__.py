"""Shapes over streams of lines."""
