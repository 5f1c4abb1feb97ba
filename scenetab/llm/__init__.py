"""Operators that prepare text corpora for training; nothing else in the package depends on this folder."""
