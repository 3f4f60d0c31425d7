"""Relational operators of the concordance analytics."""
