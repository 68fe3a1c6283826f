"""Corpus operators for training data: one module an operator, DataFrame in and DataFrame out."""
