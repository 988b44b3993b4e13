"""Readers, parsers, chunkers and sinks."""
