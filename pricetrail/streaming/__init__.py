"""Structured Streaming forms of the two stateful operators."""
