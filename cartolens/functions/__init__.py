"""Scalar functions: a Python twin of each semantic, and the column that applies it."""
