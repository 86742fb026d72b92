"""Training-data operators: extraction, counting, packing, search, deduplication and filtering."""
