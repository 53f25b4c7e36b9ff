"""Training-data operators: deduplication, quality, toxicity, privacy, language, tokens, shards and packing."""
