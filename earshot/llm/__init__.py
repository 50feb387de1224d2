"""Training-data operators: near and substring duplicates, fingerprints, classifiers, shards, tokens."""
