"""Training-data operators: deduplication, filters, scoring, packing, pieces."""
