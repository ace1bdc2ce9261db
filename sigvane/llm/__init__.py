"""Operators for preparing training text: scoring, deduplication, masking, formatting, tokens, packing."""
