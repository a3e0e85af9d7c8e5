"""Relational and document operators as DataFrame transformations."""
