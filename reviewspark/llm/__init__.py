"""Training-data operators: packing, language ID, scoring, quality, deduplication, archives, search, tokens."""
