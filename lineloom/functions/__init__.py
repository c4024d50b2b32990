"""Scalar functions over columns: scripts, lengths and scores, rewriting, ruby, titles."""
