"""Readers, stand-in views and sinks."""
