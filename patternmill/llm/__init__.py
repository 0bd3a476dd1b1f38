"""Training-data operators: media, tokens, deduplication, archives, mixing, quality, sharding and secrets."""
