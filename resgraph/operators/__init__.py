"""Relational operators over a package's relations."""
