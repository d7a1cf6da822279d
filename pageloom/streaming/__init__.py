"""Continuous evaluation: a file stream of pages through the same plan."""
