"""Training-data operators: dedup, search, packing, language, quality, privacy."""
