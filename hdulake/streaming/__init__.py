"""Streams over folders of files."""
