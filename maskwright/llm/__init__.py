"""Training-data operators: tokenising, models, deduplication and packing."""
