"""Operators for the training data of language models. Nothing outside this package imports it."""
