"""Scalar functions over bit-string keys and hash-based uniforms."""
