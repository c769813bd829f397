"""Column functions over the vector types."""

from vecspark.functions import bits, casts, dense, half, sparse, text

__all__ = ["bits", "casts", "dense", "half", "sparse", "text"]
