"""Streams of new files and lines into an index."""
