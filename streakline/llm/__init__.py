"""Operators for text corpora: mixing, language, near copies, personal data, extraction, archives."""
