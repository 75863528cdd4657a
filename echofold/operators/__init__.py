"""Relational operators: similarity join, components, clusters, regions."""
