"""Detection, relevance, resolution, masking and demasking."""
