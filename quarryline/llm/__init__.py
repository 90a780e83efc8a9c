"""Training-data operators: scoring, filtering, packing, near duplicates, search and tokens on Spark."""
