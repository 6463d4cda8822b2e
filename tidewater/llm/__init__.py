"""Training-data operators: extraction, scoring, deduplication, search, packing and mixing."""
