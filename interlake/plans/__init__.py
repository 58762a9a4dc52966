"""Interlake plans."""
