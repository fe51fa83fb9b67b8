"""Readers, writers and generated fixtures."""
