"""Operators over link tables."""
