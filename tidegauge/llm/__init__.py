"""Corpus operators for training data: documents in, decisions and real outputs out."""
