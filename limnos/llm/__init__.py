"""Training-data operators: scoring, deduplication, decontamination, token counts, mixing and sharding of documents."""
