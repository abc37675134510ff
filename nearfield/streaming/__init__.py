"""Streams of rows into an index."""
