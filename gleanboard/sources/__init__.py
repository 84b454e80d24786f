"""Readers, field maps and writers."""
