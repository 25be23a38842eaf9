"""Corpus operators: language ID, fixity, dedup, search, mixing, PII, tokens."""
