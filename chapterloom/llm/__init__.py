"""Operators for preparing training text: scoring, matching, packing and files."""
