"""Offer-price analytics on Spark: DataFrame-first operators, rules, extraction and streaming state."""
