"""Training-data operators: deduplication, filtering, extraction, formatting, mixing, tokenising."""
