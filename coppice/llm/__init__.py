"""Training-data operators: deduplication, filtering, search, scoring, mixing, packing and output."""
