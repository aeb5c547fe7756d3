"""Operators of a training-data pipeline: near-duplicates, scoring, quality, tokens, licences, personal data, packing."""
