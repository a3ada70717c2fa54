"""Behavioural user segmentation as Spark DataFrame functions."""

from segtide.periods import Period

__all__ = ["Period"]
