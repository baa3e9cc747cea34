"""Readers, writers and the typed loading of the shared tables."""
