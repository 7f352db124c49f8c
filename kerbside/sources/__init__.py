"""Readers of the files that surveys come in."""
