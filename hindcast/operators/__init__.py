"""Relational operators over DataFrames (dedup, unnest, sequences, joins, checks)."""
