"""Readers, writers and captured-document sources."""
