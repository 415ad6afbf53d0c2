"""Operators for the data of language models, each over whole tables."""
