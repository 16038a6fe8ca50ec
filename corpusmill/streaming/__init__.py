"""Watching a directory and rebuilding what changed."""
