"""Structured Streaming: watching a tree of files."""
