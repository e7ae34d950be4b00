"""Structured Streaming forms of sequence operators."""
