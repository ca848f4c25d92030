"""Readers, writers and table maintenance."""
