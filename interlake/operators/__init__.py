"""Interlake operators."""
