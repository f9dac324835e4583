"""Column expressions: strings, scores, dates, hashes, globs, labels."""
