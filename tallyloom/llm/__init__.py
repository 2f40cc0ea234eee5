"""Operators for preparing training corpora: filters, duplicate search, mixing, rendering.

Nothing else in the library imports this subpackage.
"""
