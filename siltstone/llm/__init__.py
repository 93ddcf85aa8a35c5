"""Operators for preparing language-model training data. Nothing else in siltstone imports this."""
