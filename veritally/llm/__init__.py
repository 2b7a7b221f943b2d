"""Training-data operators: deduplication, filtering, scoring, packing and sharding on Spark."""
