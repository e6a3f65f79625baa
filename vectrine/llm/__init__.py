"""Operators for building training corpora: quality, packing, de-duplication, media, search, privacy, tokens.

Nothing outside this subpackage imports it.
"""
