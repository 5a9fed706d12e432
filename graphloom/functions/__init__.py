"""Column functions: identities, IRIs, text, similarity."""
