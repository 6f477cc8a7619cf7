"""Operators for training data of language models; nothing else in the library imports this folder."""
