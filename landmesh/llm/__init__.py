"""Operators for preparing large text corpora: deduplication, quality, tokens, extraction.

The subpackage stands alone: nothing else in the library imports it.
"""
