"""Column functions: hashes, scores, rules, statistics."""
