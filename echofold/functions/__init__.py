"""Scalar helpers: options, number formatting, path handling, structural normalisation and hashing."""
