"""Corpus preparation for language-model training: ten operators, each in a module of its own."""
