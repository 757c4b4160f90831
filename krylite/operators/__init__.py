"""Operators over sparse vectors: store, compression, samplers, Hamiltonians, small dense algebra."""
