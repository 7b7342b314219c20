"""Training-data operators: fingerprints, private data, mixing, tokens, secrets,
archive fixity, near and exact duplicates, quality.

Nothing outside this subpackage imports it.
"""
