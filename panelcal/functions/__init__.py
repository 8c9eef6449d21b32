"""Column expressions: labels, scores, penalties, hash randomness, Beta and binomial terms."""
