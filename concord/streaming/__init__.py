"""Incremental forms of operators over streams of arriving rows."""
