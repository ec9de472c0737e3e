"""Training-data operators: deduplication, filtering, mixing, tokenising and packing of documents."""
