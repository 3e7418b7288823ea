"""Training-data operators: text cleaning, deduplication, counting, mixing, scoring and web archives."""
