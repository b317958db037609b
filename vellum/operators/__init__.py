"""Relational operators of a search: matching, ranking, facets, typo candidates."""
