"""Operators for large training corpora: deduplication, scoring, fingerprints, tokens, mixing."""
