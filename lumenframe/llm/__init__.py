"""Training-data operators: deduplication, tokenization, filtering, classification."""
