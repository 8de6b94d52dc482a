"""Operators for preparing large text corpora. Nothing else in folia imports this."""
