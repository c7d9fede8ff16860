"""Training-data operators: near duplicates, extraction, tokens, classifiers, mixing, search, shards."""
