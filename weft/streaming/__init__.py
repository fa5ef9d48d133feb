"""Contractions over streams."""
