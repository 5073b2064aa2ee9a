"""Relational operators: rows, joins, grouping, sets, ordering."""
