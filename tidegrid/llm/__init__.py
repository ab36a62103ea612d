"""Training-data operators: dedup, sharding, filtering, mixing, tokenising, search."""
