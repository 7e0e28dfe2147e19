"""Operators for preparing language-model training data. Nothing else in evgraph imports this."""
