"""Column functions."""

from themeloom.functions.columns import clean, cosine, dot, dress_html, hash_vector, norm, r6, strip_think, terms

__all__ = ["clean", "cosine", "dot", "dress_html", "hash_vector", "norm", "r6", "strip_think", "terms"]
