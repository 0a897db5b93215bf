"""Training-data operators: quality, dedup, tokens, secrets, mixing, HTML and media columns."""
