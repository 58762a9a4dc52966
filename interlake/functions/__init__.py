"""Interlake functions."""
