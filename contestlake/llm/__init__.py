"""Operators for building training data from a corpus, and the queries that run them."""
