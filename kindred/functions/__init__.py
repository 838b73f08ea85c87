"""Column functions on alleles, contexts, identifiers, call fields and p-values."""
