"""Operators that prepare training text: quality, licences, personal data, search, tokens, mixing, duplicates."""
