"""Streams of record lines."""
