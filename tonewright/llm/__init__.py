"""Training-data operators: fingerprints, tokenized storage, deduplication, packing, quality."""
