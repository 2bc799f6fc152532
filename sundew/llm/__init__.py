"""Operators for preparing training text: secrets, source filtering, personal details, deduplication, tokens, leaks, repetition."""
