"""Extraction: source text to symbols, calls and structural references."""
