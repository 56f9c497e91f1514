"""Structured Streaming versions of the de-dup, routing and curation steps."""
