"""Structured Streaming forms of the causal operators."""
