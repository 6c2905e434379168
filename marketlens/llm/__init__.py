"""Operators for building training corpora: documents in, decisions or files out."""
