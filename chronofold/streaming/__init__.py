"""Structured Streaming forms of the journal and of timed sweeps."""
