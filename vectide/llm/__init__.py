"""Training-data operators: scoring, deduplication, tokenising, mixing, sharding and archiving."""
