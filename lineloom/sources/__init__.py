"""Readers: tables, files of captions, books, scanned pages, plain text, Markdown and word lists."""
