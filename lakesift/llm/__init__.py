"""Operators on text for training corpora; nothing outside this package imports it."""
