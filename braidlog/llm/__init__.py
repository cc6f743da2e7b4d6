"""Corpus preparation operators; no other part of the library imports this subpackage."""
