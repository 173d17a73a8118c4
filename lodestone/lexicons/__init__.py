"""Lexicon files, one a language."""
