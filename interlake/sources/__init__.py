"""Interlake sources."""
