"""Operators on text corpora; nothing outside this package imports it."""
