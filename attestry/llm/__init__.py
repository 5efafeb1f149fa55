"""Training-data operators: decontamination, dedup, formatting, scoring, packing."""
