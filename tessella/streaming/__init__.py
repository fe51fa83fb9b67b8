"""Structured Streaming run modes of stateless operators."""
