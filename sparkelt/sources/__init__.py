"""Readers, writers and the paths they use."""
