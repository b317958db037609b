"""Expressions over text columns: analysis, normalisation, edit distance, snippets."""
