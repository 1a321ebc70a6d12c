"""Training-data operators: tokenising, scoring, deduplication, decontamination, filtering and archives."""
