"""Training-data operators: filters, dedup, tokenising, packing and search for text corpora."""
