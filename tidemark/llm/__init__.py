"""Operators for preparing training data: filters, joins, searches, mixing, tokens and scores."""
