"""Scalar expressions: plain columns in, plain columns out."""
