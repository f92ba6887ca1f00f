"""Scalar functions as column expressions, and hashes for Arrow batches."""
