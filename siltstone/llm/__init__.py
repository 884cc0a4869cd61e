"""Training-data operators: deduplication, decontamination, packing, screening and media."""
