"""Whole flows: building a dataset, building and evaluating retrieval."""
