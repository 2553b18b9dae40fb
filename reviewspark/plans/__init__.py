"""Whole flows: the test relation and the analysis of requests."""
