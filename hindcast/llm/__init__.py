"""Training-data operators: toxicity, quality, secrets, duplicates, extraction,
tokens, packing and sharding.  Nothing else in the library imports this folder."""
