"""Interlake streaming."""
