"""Operators for corpora that language models are trained on; nothing else in the library imports this."""
