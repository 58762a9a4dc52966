"""Interlake: message and interaction analytics as composable Spark DataFrame transforms."""
