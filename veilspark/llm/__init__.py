"""Training-data operators: deduplication, packing, token counts, scoring, cleaning."""
