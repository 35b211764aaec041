"""Training-data operators: search, deduplication, filtering, tokens and mixing."""
