"""Structured Streaming forms of the operators (processing time, as in the reference)."""
