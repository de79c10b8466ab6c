"""Chains of operators: curation of candidates, document cards, questions as a table."""
