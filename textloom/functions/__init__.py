"""Column builders: string, token-array, JSON, math and hash functions."""
