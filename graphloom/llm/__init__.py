"""Operators that prepare text, vectors and pages for training language models."""
