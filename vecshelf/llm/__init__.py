"""Operators that a training-data pipeline needs: scoring, filtering, near
duplicates, tokens and packing. Nothing else in the library imports this folder."""
