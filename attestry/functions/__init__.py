"""Scalar functions: text, sentences, quantities and stems."""
