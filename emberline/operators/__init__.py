"""Relational operators over events, matches, documents and vectors."""
