"""Training-data operators: deduplication, tokenising, fingerprints, language, packing, scoring."""
