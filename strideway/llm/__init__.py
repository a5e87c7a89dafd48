"""Training-data operators: deduplication, filters, mixing, tokens and packing."""
